"""Benchmark items inside documents: size-partitioned MinHash containment search in DataFrame operations only.

An item's own minima are the sketch: under each of k hash orders, the item's smallest shingle lies in a document with a
chance that equals the share of the item the document contains, however long the document is. Items are partitioned by
size; a partition sets k and how many minima a document must hold to be a candidate, so that an item contained to the
threshold is missed with a chance of ``MISS`` at most while larger items, which share more passages with other texts,
must hit more often. Candidates are confirmed by the exact share of the item's distinct shingles that they hold.

Words are runs without space, tab, LF, VT, FF and CR, with A-Z as a-z; shingles have five words. A text with fewer words
is one shingle, its whole sequence, so a short item is found only as the whole of a short document.

Edge cases: null, empty or wordless texts and items match nothing; rows that repeat a doc_id or item_id count as one
document or item with the union of their shingles; null ids never match; further columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
MISS = 1e-9
#: Items up to this many distinct shingles are broadcast with their sketches; larger tables are joined by shuffle.
BROADCAST_ROWS = 200_000


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Array of 64-bit shingle hashes of a text, not yet distinct; null where the text has no word."""
    words = F.split(F.regexp_replace(common.ascii_lower(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def roll(h: Column) -> Column:
        n = F.size(h)
        at = F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))
        return F.when(n >= width, F.transform(at, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(width)]))).otherwise(F.array(F.xxhash64(F.concat_ws(" ", h.cast("array<string>")))))

    rolled = F.element_at(F.transform(F.array(hashed), roll), 1)
    return F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), rolled)


def orders_for(part: int, threshold: float) -> tuple[int, int]:
    """Hash orders of a size partition, and how many of them must hit.

    Larger items get more orders; as many hits are asked for as an item at the threshold reaches but for ``MISS``.
    """
    least = math.ceil(math.log(MISS) / math.log(1 - threshold))
    k = min(60, least + 4 * part)
    missed, h = 0.0, 0
    while missed <= MISS and h < k:
        missed += math.comb(k, h) * threshold**h * (1 - threshold) ** (k - h)
        h += 1
    return k, max(1, h - 1)


def item_sketches(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(item_id, size, shingle) of every distinct shingle, and (shingle, item_id, orders, need) of the sketches.

    Partition p holds the sizes from 2^p up to 2^(p+1); ``orders`` has a bit for each hash order under which the
    shingle is the item's minimum, ``need`` the number of bits that make a document a candidate.
    """
    each = items.where("item_id is not null").select("item_id", F.explode(shingles(F.col("text"))).alias("shingle")).distinct()
    sizes = each.groupBy("item_id").agg(F.count("*").alias("size"))
    sets = common.cut(each.join(sizes, "item_id"), "items")
    table = [orders_for(p, threshold) for p in range(63)]
    part = F.floor(F.log2("size")).cast("int") + 1
    k, need = (F.element_at(F.array(*[F.lit(x[i]) for x in table]), part) for i in (0, 1))
    drawn = sets.select("item_id", "shingle", need.alias("need"), F.explode(F.sequence(F.lit(0), k - 1)).alias("order"))
    least = drawn.groupBy("item_id", "order").agg(F.min(F.struct(F.xxhash64("order", "shingle").alias("h"), "shingle", "need")).alias("m"))
    bit = F.expr("shiftleft(1L, order)")
    return sets, least.groupBy("m.shingle", "item_id").agg(F.bit_or(bit).alias("orders"), F.first("m.need").alias("need"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every item that a document holds to the threshold or more."""
    sets, sketch = item_sketches(items, threshold)
    fits = sets.count() <= BROADCAST_ROWS
    near = F.broadcast if fits else lambda d: d
    found = docs.where("doc_id is not null").select("doc_id", F.explode(shingles(F.col("text"))).alias("shingle"))
    hits = found.join(near(sketch), "shingle").groupBy("doc_id", "item_id").agg(F.bit_or("orders").alias("orders"), F.first("need").alias("need"))
    candidates = common.cut(hits.where(F.bit_count("orders") >= F.col("need")).select("doc_id", "item_id"), "candidates")
    texts = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    again = texts.select("doc_id", F.explode(F.array_distinct(shingles(F.col("text")))).alias("shingle"))
    shared = again.join(near(sets), "shingle").join(candidates, ["doc_id", "item_id"], "left_semi")
    counted = shared.groupBy("doc_id", "item_id", "size").agg(F.count_distinct("shingle").alias("n_shared"))
    share = F.col("n_shared") / F.col("size")
    return counted.where(F.col("n_shared") >= F.col("size") * threshold).select("doc_id", "item_id", "n_shared", F.col("size").alias("n_item"), share.alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item to the threshold; rows without a doc_id stay."""
    leaks = contained(docs, items, threshold).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark WHERE item_id IS NOT NULL
), grams AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
), sized AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM grams WHERE kind = 1)
SELECT d.id AS doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM grams d JOIN sized USING (g) WHERE d.kind = 0
GROUP BY d.id, item_id, n_item HAVING count(*) >= n_item * 0.8
"""
