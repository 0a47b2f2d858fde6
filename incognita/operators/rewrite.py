"""Rewriting: entities become aliases, from right to left, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import ENTITIES, let, slice_of

ALIAS = "struct<original:string,alias:string,prefix:string,n:bigint>"
ALIASES = f"array<{ALIAS}>"
_PLACED = "array<struct<start:int,end:int,alias:string>>"


def applied(text: Column, entities: Column) -> Column:
    """Entities that are rewritten, rightmost first: their text is the slice at their place, clear of those to the right."""
    zero = F.struct(F.lit((1 << 31) - 1).alias("limit"), F.array().cast(ENTITIES).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        fits = (e["end"] <= acc["limit"]) & (slice_of(text, e) == e["text"])
        return F.when(fits, F.struct(e["start"].alias("limit"), F.concat(acc["out"], F.array(e)).alias("out"))).otherwise(acc)

    return F.aggregate(F.reverse(F.array_sort(entities)), zero, step, lambda acc: acc["out"])


def aliases(applied_entities: Column, known: Column | None = None, base: Column | None = None) -> Column:
    """New aliases in the order in which they are given: one for each text, numbered by prefix.

    The prefix is the category or else the label. ``known`` (map of original to alias) has the aliases of earlier runs,
    ``base`` (map of prefix to number) the last number given to each prefix.
    """

    def step(acc: Column, e: Column) -> Column:
        prefix = F.coalesce(F.nullif(e["category"], F.lit("")), e["label"])
        had = F.exists(acc, lambda a: a["original"] == e["text"])
        if known is not None:
            had = had | F.coalesce(F.map_contains_key(known, e["text"]), F.lit(False))
        n = F.size(F.filter(acc, lambda a: a["prefix"] == prefix)).cast("bigint") + 1
        if base is not None:
            n = n + F.coalesce(F.try_element_at(base, prefix), F.lit(0))
        alias = F.concat(F.lit("<"), prefix, F.lit("_"), n.cast("string"), F.lit(">"))
        new = F.struct(e["text"].alias("original"), alias.alias("alias"), prefix.alias("prefix"), n.alias("n"))
        return F.when(had, acc).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(applied_entities, F.array().cast(ALIASES), step)


def occurrence_aliases(applied_entities: Column) -> Column:
    """An alias for every occurrence, rightmost first, numbered by label."""

    def step(acc: Column, e: Column) -> Column:
        n = F.size(F.filter(acc, lambda a: a["prefix"] == e["label"])).cast("bigint") + 1
        alias = F.concat(F.lit("<"), e["label"], F.lit("_"), n.cast("string"), F.lit(">"))
        return F.concat(acc, F.array(F.struct(e["text"].alias("original"), alias.alias("alias"), e["label"].alias("prefix"), n.alias("n"))))

    return F.aggregate(applied_entities, F.array().cast(ALIASES), step)


def placed(applied_entities: Column, table: Column) -> Column:
    """start, end and alias of each applied entity; ``table`` maps original to alias."""
    return F.transform(applied_entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.try_element_at(table, e["text"]).alias("alias")))


def rewritten(text: Column, replacements: Column) -> Column:
    """The text with each (start, end, alias) replaced; places don't overlap. The text is put together once."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, r: Column) -> Column:
        parts = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, r["start"] - acc["at"]), r["alias"]))
        return F.struct(r["end"].alias("at"), parts.alias("parts"))

    def whole(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, (1 << 31) - 1))

    return F.aggregate(F.array_sort(replacements), zero, step, whole)


def pseudonymized(text: Column, applied_entities: Column, new: Column, known: Column | None = None) -> Column:
    """The text with the aliases in place of their originals."""
    pairs = F.map_from_entries(F.transform(new, lambda a: F.struct(a["original"], a["alias"])))
    table = F.map_concat(pairs, known) if known is not None else pairs
    return let(table, lambda m: rewritten(text, placed(applied_entities, m)))


def restored(text: Column, table: Column) -> Column:
    """The text with every alias of the table (array of aliases) replaced by its original, in the table's order."""
    return F.aggregate(table, text, lambda t, a: F.replace(t, a["alias"], a["original"]))


def corpus_aliases(entities: DataFrame, blocks: int = 32) -> DataFrame:
    """One numbering for a whole corpus: original, alias, prefix, n from rows (doc_id, start, text, prefix) of applied entities.

    An original takes the prefix of its first occurrence (smallest doc_id, rightmost place). Numbers are dense by prefix:
    prefixes are cut into blocks by the originals' hashes, blocks counted, and each block numbered from its offset, so
    that one prefix with most of the rows is spread over many tasks.
    """
    order = F.struct("doc_id", -F.col("start"), "prefix")
    first = entities.groupBy(F.col("text").alias("original")).agg(F.min(order).alias("o")).select("original", F.col("o.prefix").alias("prefix"), F.col("o.doc_id").alias("doc_id"))
    block = F.pmod(F.xxhash64("original"), F.lit(blocks)).cast("int")
    cut = first.withColumn("block", block)
    counts = cut.groupBy("prefix", "block").agg(F.count("*").alias("c"))
    sums = counts.withColumn("offset", F.sum("c").over(Window.partitionBy("prefix").orderBy("block")) - F.col("c")).drop("c")
    own = F.row_number().over(Window.partitionBy("prefix", "block").orderBy("original"))
    n = (own + F.col("offset")).cast("bigint")
    numbered = cut.join(sums, ["prefix", "block"]).withColumn("n", n)
    return numbered.select("original", F.concat(F.lit("<"), "prefix", F.lit("_"), F.col("n").cast("string"), F.lit(">")).alias("alias"), "prefix", "n")
