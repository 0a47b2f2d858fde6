"""Fusion of establishment types with adjacent names, and the fold that leaves no conflicting entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import lexicon
from .entities import ENTITIES, ENTITY, changed, numbered


def _is_type(e: Column) -> Column:
    return (e["source"] == "RULES") & e["category"].isin(lexicon.FUSABLE)


def fuses(e: Column, following: Column) -> Column:
    """Whether a type is fused with the entity that follows it."""
    near = (following["start"] - e["end"]) <= lexicon.FUSION_GAP
    return F.coalesce(_is_type(e) & following["label"].isin("LOC", "PER") & (following["source"] == "NER") & near, F.lit(False))


def fused(text: Column, entities: Column) -> Column:
    """Types joined with the names that follow them; lone types and services without a name are gone.

    The entities are sorted by place. A consumed name is NER's, hence never itself a type, so neighbours decide alone.
    """
    ordered = F.array_sort(entities)

    def joined(x: Column) -> Column:
        def at(i: Column) -> Column:
            return F.get(x, i)

        def one(e: Column, i: Column) -> Column:
            after = at(i + 1)
            category = F.when(e["category"].startswith("ETAB_"), e["category"]).otherwise(F.concat(F.lit("ETAB_"), e["category"]))
            both = changed(
                e,
                end=after["end"],
                text=F.substring(text, e["start"] + 1, after["end"] - e["start"]),
                label=F.lit("ETAB"),
                category=category,
                source=F.lit("MERGED_TYPE_LOC"),
                score=F.greatest(e["score"], after["score"]),
            )
            consumed = F.when(i > 0, fuses(at(i - 1), e)).otherwise(False)
            gone = consumed | (_is_type(e) & ~fuses(e, after)) | F.coalesce(e["category"].isin(lexicon.SERVICES), F.lit(False))
            return F.when(fuses(e, after), both).when(~gone, e)

        return F.filter(F.transform(x, one), lambda e: e.isNotNull())

    return F.element_at(F.transform(F.array(ordered), joined), 1).cast(ENTITIES)


def priority_key(e: Column) -> Column:
    """The key under which an entity's priority is kept."""
    return (
        F.when(e["source"] == "MERGED_TYPE_LOC", "MERGED_TYPE_LOC_ETAB")
        .when(e["source"] == "GAZETTEER", F.concat(F.lit("GAZETTEER_"), e["label"]))
        .when(e["source"] == "RULES", F.concat(F.lit("RULES_"), F.coalesce(F.nullif(e["category"], F.lit("")), e["label"])))
        .otherwise(F.concat(F.lit("NER_"), e["label"]))
    )


def priority(e: Column) -> Column:
    """The entity's priority: its key's, or else that of its source and label."""
    table = F.create_map(*(F.lit(x) for pair in lexicon.PRIORITIES.items() for x in pair))
    default = (
        F.when(e["source"] == "ENHANCED", 4.5)
        .when(e["source"] == "GAZETTEER", 5.0)
        .when(e["source"] == "RULES", F.when(e["label"].isin(lexicon.SENSITIVE), 4.0).when(e["label"] == "ETAB", 3.5).otherwise(3.0))
        .when(e["label"] == "PER", 2.0)
        .otherwise(1.0)
    )
    return F.coalesce(F.try_element_at(table, priority_key(e)), default)


def overlap(a: Column, b: Column) -> Column:
    """Shared length over the shorter length; 0 where disjoint."""
    shared = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    shorter = F.least(a["end"] - a["start"], b["end"] - b["start"])
    return F.when((shared > 0) & (shorter > 0), shared / shorter).otherwise(0.0)


def resolved(entities: Column) -> Column:
    """Entities by place, none overlapping another by more than ``OVERLAP``.

    Each is held against those accepted so far: it loses to a conflicting one that is longer by more than
    ``SIMILAR_LENGTH``, or of similar length and no lower priority; else it replaces all that it conflicts with.
    """
    ranked = F.transform(F.array_sort(entities), lambda e: F.struct(e.alias("e"), priority(e).alias("p")))

    def conflicting(a: Column, b: Column) -> Column:
        return overlap(a["e"], b["e"]) > lexicon.OVERLAP

    def step(kept: Column, x: Column) -> Column:
        def beats(k: Column) -> Column:
            longer = (k["e"]["end"] - k["e"]["start"]) - (x["e"]["end"] - x["e"]["start"])
            return conflicting(x, k) & F.when(F.abs(longer) > lexicon.SIMILAR_LENGTH, longer > 0).otherwise(k["p"] >= x["p"])

        return F.when(F.exists(kept, beats), kept).otherwise(F.concat(F.filter(kept, lambda k: ~conflicting(x, k)), F.array(x)))

    folded = F.aggregate(ranked, F.array().cast(f"array<struct<e:{ENTITY},p:double>>"), step)
    return F.array_sort(F.transform(folded, lambda k: k["e"]))


