"""Candidates: rule, gazetteer and named-entity matches of a document, in emission order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import spans, words_of
from ..functions.text import strip
from ..sources import catalog, lexicon
from .entities import ENTITIES, changed, entity, let, none, numbered

#: Gazetteer entries that may be a constant of the plan; more are joined with the texts' words.
LITERAL_ENTRIES = 5000
_RULE = "array<struct<label:string,category:string,pattern:string,geo:boolean,anchors:array<string>>>"
_NAME = "array<struct<label:string,category:string,pattern:string,anchors:array<string>,least:int>>"


def _constant(values: list[dict], schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), schema)


def _active(entries: Column, words: Column) -> Column:
    """Entries that may match a text with these words."""
    return F.filter(entries, lambda r: (F.size(r["anchors"]) == 0) | F.arrays_overlap(r["anchors"], words))


def trimmed(s: Column) -> Column:
    """A span without white space at its ends; empty texts stay to be filtered."""
    text = strip(s["text"])
    start = s["start"] + F.length(s["text"]) - F.length(F.regexp_replace(s["text"], r"(?U)^\s+", ""))
    return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))


def extended(text: Column, e: Column) -> Column:
    """The entity with a place that follows it (a preposition and capitalized words), joined by one space.

    The stored text may differ from the slice then: where the gap isn't one space, or white space ends the place.
    """
    place = F.regexp_extract(F.substring(text, e["end"] + 1, 1 << 30), f"(?U){lexicon.GEO}", 0)
    return let(place, lambda p: F.when(p == "", e).otherwise(changed(e, text=F.concat_ws(" ", e["text"], strip(p)), end=e["end"] + F.length(p))))


def anchors_of_all(rules: list[catalog.Rule], gazetteers: dict[str, list[tuple[str, str]]]) -> list[str]:
    """The words and signs that rules and names look for."""
    return sorted({a for r in rules for a in r.anchors} | {w for names in gazetteers.values() for n, _ in names for w in first_word(n)})


def rule_entities(text: Column, held: Column, rules: list[catalog.Rule]) -> Column:
    """The matches of all rules in order; ``held`` are the anchors that the text holds."""
    if not rules:
        return none()
    table = _constant([{"label": r.label, "category": r.category, "pattern": catalog.java(r), "geo": r.extend_geo, "anchors": list(r.anchors)} for r in rules], _RULE)

    def of_rule(t: Column, r: Column) -> Column:
        found = F.filter(F.transform(spans(t, r["pattern"]), trimmed), lambda s: s["text"] != "")

        def of_match(s: Column) -> Column:
            e = entity(start=s["start"], end=s["end"], text=s["text"], label=r["label"], source=F.lit("RULES"), category=r["category"], score=F.lit(1.0))
            return F.when(r["geo"], extended(t, e)).otherwise(e)

        return F.transform(found, of_match)

    return F.flatten(F.transform(_active(table, held), lambda r: of_rule(text, r)))


def first_word(name: str) -> list[str]:
    """The word that a name begins with, lower-cased; none if it begins otherwise."""
    word = ""
    for c in name.lower():
        if not (c.isalnum() or c == "_"):
            break
        word += c
    return [word] if word else []


def _entry(name: str, category: str) -> dict:
    return {
        "label": "ETAB" if category.startswith("ETAB_") else "ORG",
        "category": category,
        "pattern": rf"(?iuU)\b\Q{name}\E\b",
        "anchors": first_word(name),
        "least": 1 if category.endswith("_CP") else 2,
    }


def _named(text: Column, entries: Column) -> Column:
    """The matches of gazetteer entries in a text, in the entries' order."""

    def of_name(t: Column, r: Column) -> Column:
        found = F.filter(spans(t, r["pattern"]), lambda s: F.length(strip(s["text"])) >= r["least"])
        return F.transform(found, lambda s: entity(start=s["start"], end=s["end"], text=strip(s["text"]), label=r["label"], source=F.lit("GAZETTEER"), category=r["category"], score=F.lit(1.0)))

    return F.flatten(F.transform(entries, lambda r: of_name(text, r)))


def size_of(gazetteers: dict[str, list[tuple[str, str]]]) -> int:
    """The number of entries."""
    return sum(map(len, gazetteers.values()))


def gazetteer_entities(text: Column, held: Column, gazetteers: dict[str, list[tuple[str, str]]]) -> Column:
    """The names of all gazetteers, in any case, between word boundaries; gazetteers in the order of their names."""
    entries = [_entry(name, category) for _, names in sorted(gazetteers.items()) for name, category in names]
    if len(entries) > LITERAL_ENTRIES:
        raise ValueError(f"{len(entries)} gazetteer entries; at most {LITERAL_ENTRIES} can be a constant of the plan")
    return _named(text, _active(_constant(entries, _NAME), held)) if entries else none()


def joined_entities(docs: DataFrame, gazetteers: DataFrame) -> DataFrame:
    """The documents with the column ``names``: what ``gazetteer_entities`` finds, for gazetteers of any size.

    ``gazetteers`` has rows (gazetteer, name, category), matched in the order of gazetteer, name and category. A text that
    holds a name holds its words; each name is sought under that of its words which the fewest names have. Words of
    texts are joined with the names under a digest of the text, of whose rows each task sends a name once; then texts move
    once to what was found for them. Names without a word are tried on all texts, and must be few. Rows that repeat a name
    are sought once.
    """
    least = F.when(F.col("category").endswith("_CP"), 1).otherwise(2)
    label = F.when(F.col("category").startswith("ETAB_"), "ETAB").otherwise("ORG")
    pattern = F.concat(F.lit("(?iuU)\\b\\Q"), "name", F.lit("\\E\\b"))
    order = F.struct("gazetteer", "name", "category")
    table = gazetteers.select(order.alias("order"), F.struct(label.alias("label"), "category", pattern.alias("pattern"), F.array().cast("array<string>").alias("anchors"), least.alias("least")).alias("entry"), F.filter(words_of(F.col("name")), lambda w: w != "").alias("words"))
    each = table.select("order", "entry", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "word").groupBy("order", "entry").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    digest = F.sha2("text", 256)
    texts = docs.select(digest.alias("key"), F.explode(words_of(F.col("text"))).alias("word"))
    found = texts.join(rarest, "word").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("order", "entry"))).alias("found"))
    wordless = table.where(F.size("words") == 0).agg(F.array_sort(F.collect_list(F.struct("order", "entry"))).alias("wordless"))
    both = docs.withColumn("key", digest).join(found, "key", "left").crossJoin(F.broadcast(wordless))
    entries = F.array_sort(F.concat(F.coalesce("found", F.slice("wordless", 1, 0)), F.col("wordless")))
    return both.withColumn("names", _named(F.col("text"), F.transform(entries, lambda x: x["entry"]))).drop("key", "found", "wordless")


def ner_entities(text: Column, annotations: Column) -> Column:
    """Annotations (start, end, label, score) of persons, organisations and places as entities: sliced, trimmed."""

    def of(a: Column) -> Column:
        s = trimmed(F.struct(a["start"].alias("start"), a["end"].alias("end"), F.substring(text, a["start"] + 1, a["end"] - a["start"]).alias("text")))
        return let(s, lambda x: entity(start=x["start"], end=x["end"], text=x["text"], label=a["label"], source=F.lit("NER"), score=a["score"]))

    usable = F.filter(annotations, lambda a: a["label"].isin("PER", "ORG", "LOC") & a["start"].isNotNull() & a["end"].isNotNull())
    return F.coalesce(F.filter(F.transform(usable, of), lambda e: e["text"] != ""), none())


def candidates(ner: Column, rules: Column, names: Column) -> Column:
    """All candidates: named entities, rules, gazetteers, in this order, numbered."""
    return numbered(F.concat(ner, rules, names).cast(ENTITIES))
