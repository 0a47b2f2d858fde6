"""Filters, context reclassification and disambiguation of candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import norm_key, strip
from ..sources import lexicon
from .entities import changed, let, slice_of


def _words(values: list[str]) -> Column:
    return F.lit(values).cast("array<string>")


def _any_of(text: Column, values: list[str]) -> Column:
    """Whether the text holds any of the values."""
    return text.rlike("|".join(re.escape(v) for v in values))


# --- filters ------------------------------------------------------------------------------------------------------


def not_stopword(text: Column, e: Column) -> Column:
    """Whether the slice at the entity's place is no stop word."""
    return ~F.lower(slice_of(text, e)).isin(lexicon.STOPWORDS)


def not_excluded(e: Column, exclusions: list[str]) -> Column:
    """Whether neither the stripped text nor its lower case is excluded."""
    if not exclusions:
        return F.lit(True)
    text = strip(e["text"])
    return ~(text.isin(exclusions) | F.lower(text).isin(exclusions))


def valid(e: Column) -> Column:
    """Whether the entity is none of those that never are: fragments, ambiguous letters, job titles, generic bodies."""
    text = strip(e["text"])
    org, low = e["label"] == "ORG", F.lower(text)
    alphabetic = text.rlike(r"^\p{L}+$")
    return (
        (F.length(text) >= 2)
        & ~text.isin(lexicon.FRAGMENTS)
        & ~(org & (F.length(text) <= 2) & alphabetic)
        & ~(text.isin(lexicon.AMBIGUOUS) & e["label"].isin("ORG", "ETAB"))
        & ~_any_of(low, lexicon.JOB_TITLES)
        & ~(org & ~e["category"].eqNullSafe("ORG_ENTREPRISE_PRIV") & low.isin(lexicon.GENERIC_ORGS))
    )


def is_habitat_alone(text: Column) -> Column:
    """Whether the text is the ambiguous word alone."""
    return F.lower(F.trim(text)) == "habitat"


def has_etab_exclude_token(text: Column) -> Column:
    """Whether the text holds a word that no establishment's name has."""
    return _any_of(F.lower(text), lexicon.ETAB_TOKENS)


# --- reclassification ---------------------------------------------------------------------------------------------


def _around(text: Column, e: Column, n: int) -> Column:
    """The lower-cased text from n before to n after the entity."""
    start = F.greatest(e["start"] - n, F.lit(0))
    return F.lower(F.substring(text, start + 1, e["end"] + n - start))


def is_establishment_name(name: Column, context: Column) -> Column:
    """Articles, host verbs nearby and plants tell an establishment's name."""
    key = norm_key(name)
    low = F.lower(key)
    article = key.rlike("^(?:" + "|".join(map(re.escape, lexicon.ARTICLES)) + ")")
    return (article & ~_any_of(low, lexicon.ARTICLE_CITIES)) | _any_of(context, lexicon.HOST_VERBS) | _any_of(low, lexicon.PLANTS)


def _named(e: Column, label: Column | str, source: str = "ENHANCED") -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return changed(e, label=label, category=label, source=F.lit(source))


def reclassified(text: Column, e: Column) -> Column:
    """The entity as its text and surroundings name it; only raw NER entities change, and the first case that holds wins."""
    ner = e["source"] == "NER"
    place, body = e["label"] == "LOC", e["label"] == "ORG"
    low = F.lower(e["text"])
    before = F.upper(strip(F.substring(text, F.greatest(e["start"] - 15, F.lit(0)) + 1, F.least(e["start"], F.lit(15)))))
    adjacent = _any_of(before, lexicon.ADJACENT_TYPES)
    chu = e["text"].rlike("|".join(f"(?:(?iuU){p})" for p in lexicon.CHU_NAMES))
    address = low.rlike("(?U)" + "|".join(lexicon.ADDRESS))
    address_label = F.when(e["text"].rlike(r"(?U)\b\d{5}\b"), "ADDR_FULL").otherwise("ADDR_STREET")
    city = low.rlike(r"(?U)\b(?:" + "|".join(map(re.escape, lexicon.CITIES)) + r")\b|\bparis\s+\d{1,2}\b")
    typed = F.coalesce(*(F.when(F.upper(e["text"]).startswith(t), F.lit(f"ETAB_{t}")) for t in lexicon.NAME_TYPES))
    near = _around(text, e, 30)
    hosted = F.coalesce(*(F.when(_any_of(near, words), F.lit(t)) for t, words in lexicon.CONTEXT_TYPES.items()))
    hosted = F.when(is_establishment_name(e["text"], near), hosted)
    person = e["text"].rlike("(?U)" + "|".join(lexicon.PERSONS))
    after = F.regexp_extract(F.substring(text, e["end"] + 1, 50), r"(?U)^\s+([A-Z][a-z]+(?:-[A-Z][a-z]+)*)", 0)
    town = strip(after)
    longer = low.contains("chu") & (after != "") & ~F.lower(town).isin(lexicon.CHU_STOP)

    def extended_chu(x: Column) -> Column:
        return changed(_named(x, "ORG_CHU_CH"), text=F.concat_ws(" ", x["text"], town), end=x["end"] + F.length(after))

    changed_entity = (
        F.when((place | body) & chu, _named(e, "ORG_CHU_CH"))
        .when((place | body) & address & ~adjacent, _named(e, address_label))
        .when((place | body) & city & ~adjacent, _named(e, "LOC_CITY"))
        .when(place & typed.isNotNull(), _named(e, typed, "NER_ENHANCED"))
        .when(place & ~adjacent & hosted.isNotNull(), _named(e, hosted))
        .when(body & person, changed(e, label=F.lit("PER"), source=F.lit("ENHANCED")))
        .when((place | body) & longer, extended_chu(e))
        .otherwise(e)
    )
    return F.when(ner & (place | body), changed_entity).otherwise(e)


def disambiguated(text: Column, e: Column) -> Column:
    """A person right after a professional title becomes a profession."""
    context, name = _around(text, e, 50), F.lower(e["text"])
    titled = F.contains(context, F.concat(F.lit(lexicon.TITLES[0]), name))
    for t in lexicon.TITLES[1:]:
        titled = titled | F.contains(context, F.concat(F.lit(t), name))
    return F.when((e["label"] == "PER") & titled, _named(e, "PROFESSION", "CONTEXTUAL_PROFESSION")).otherwise(e)


def is_person_name(text: Column) -> Column:
    """Whether the stripped text has the form of a person's full name."""
    return strip(text).rlike("(?U)" + "|".join(lexicon.PERSON_FORMS))


def has_person_context(context: Column, name: Column) -> Column:
    """Whether the lower-cased surroundings of a name tell a person: civilities, functions, ages."""
    low = F.lower(strip(name))
    found = F.lit(False)
    for form in lexicon.PERSON_CONTEXT:
        before, gap, after = form.partition("{}")
        found = found | F.contains(context, F.concat(F.lit(before), low, F.lit(after)) if gap else F.lit(form))
    return found


def filtered(text: Column, entities: Column, exclusions: list[str]) -> Column:
    """Without stop words, excluded and invalid entities."""
    return F.filter(entities, lambda e: not_stopword(text, e) & not_excluded(e, exclusions) & valid(e))


def classified(text: Column, entities: Column) -> Column:
    """Reclassified, then disambiguated."""
    return F.transform(entities, lambda e: let(reclassified(text, e), lambda x: disambiguated(text, x)))
