"""Near-duplicate documents by b-bit MinHash.

The sets of equal documents collapse into classes first. For each class, minima of independent hash orders are cut into
bands; a band's hash is a bucket. Of every minimum four low bits are kept and packed into 64-bit words, so that bit
counts give a collision-corrected estimate of the similarity of two documents without their texts.

Candidates don't grow with the square of a bucket: each bucket has a hub of its own and its members are held against hubs
only. The best-looking of these pairs are confirmed on full sets and the links contracted to components. Buckets that still
span several components are gone through in rounds: one representative of each component is held against those of a few,
by longer signatures, whose errors are small, then by full sets; links are contracted and the buckets looked at again.
Once a round finds no link (or after ``ROUNDS``), what is left in buckets of several components is similar but mostly not
linked; these members are held against each other by their signatures, a bucket's pairs spread over cells of bounded size
and each pair in one bucket, and pairs near the threshold are confirmed on full sets, which makes the result whole.

Hot keys never meet in a task: joins on buckets, hubs, components and sets treat keys with many rows apart (see
``common.unskewed``) or deal their rows over several copies of the other side.

Edge cases: null or empty text and text without words have no shingles, link with nothing and are kept; rows that
repeat a doc_id are judged by their own texts; rows without a doc_id take no part and come back with a null component,
kept; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common
from .common import mix

ROWS = 5
#: Low bits kept of each minimum, in the first signature and in the sharper one of the second round.
BITS = 4
SHARP_BITS = 2
#: Minima in the sharper signature.
SHARP = 1024
#: Chance that a pair exactly at the threshold shares no bucket.
MISS = 1e-6
#: Standard errors below the threshold at which an estimate still counts as a candidate.
MARGIN = 4.0
#: Pairs of a document that are confirmed first; the rounds see all that remain.
FIRST = 4
#: Rounds of representatives before all members left are compared, and components of a bucket that the others meet.
ROUNDS = 1
HUBS = 4
#: Members of a bucket that make a cell when they are compared with each other.
CELL = 256
#: Links that a task handles when components are sought.
LINKS_A_TASK = 1 << 20


def bands_for(threshold: float) -> int:
    """Bands of ``ROWS`` minima so that a pair at the threshold is missed with a chance of ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _orders(k: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """k minima of each non-empty set; ``values`` holds the sets one after another."""
    orders, out = _orders(k), np.empty((len(sizes), k), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + 65536, "right")) - 1)
        x, at = values[starts[first] : starts[last]], starts[first:last] - starts[first]
        for j, a in enumerate(orders):
            out[first:last, j] = np.minimum.reduceat((x * a) >> np.uint64(32), at)
        first = last
    return out


def pack(m: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of the minima, packed into 64-bit words."""
    each = 64 // bits
    words = -(-m.shape[1] // each)
    full = np.zeros((len(m), words * each), np.uint64)
    full[:, : m.shape[1]] = m & np.uint32(2**bits - 1)
    shift = np.arange(each, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_or.reduce(full.reshape(len(m), words, each) << shift, axis=2)


def floor(threshold: float, k: int, bits: int) -> float:
    """The least estimate that makes a candidate: ``MARGIN`` standard errors below the threshold."""
    e = threshold + (1 - threshold) / 2**bits
    return threshold - MARGIN * math.sqrt(e * (1 - e) / k) / (1 - 2.0**-bits)


def band_keys(m: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit bucket for each band of each document."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(m), 1))
    rows = m.reshape(len(m), bands, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = mix(key + rows[:, :, r] + np.uint64(1))
    return key


def _lists(a: np.ndarray, n: int) -> pa.ListArray:
    each = a.shape[1] if len(a) else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), pa.array(a.reshape(-1).view(np.int64)))


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    return common.distinct_per_text(*common.shingle_hashes(*common.word_hashes(texts.to_pylist()), width))


def _identity(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; equal sets, and for all practical purposes only those, agree in both."""
    k1, k2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    if len(values):
        some = sizes > 0
        at = np.concatenate([[0], np.cumsum(sizes[some])])[:-1]
        k1[some] = np.add.reduceat(values, at)
        k2[some] = np.bitwise_xor.reduceat(mix(values + np.uint64(1)), at)
    return k1, k2


def sketches(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (the set's identity), bands and sig of every document."""
    k = bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, 1):
                values, sizes = _sets(b.column(1), width)
                k1, k2 = _identity(values, sizes)
                some = sizes > 0
                n = len(sizes)
                keys, sig = np.zeros((n, bands), np.uint64), np.zeros((n, -(-k * BITS // 64)), np.uint64)
                if some.any():
                    m = minima(values, sizes[some], k)
                    keys[some], sig[some] = band_keys(m, bands), pack(m, BITS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), _lists(keys, n), _lists(sig, n)],
                    ["doc_id", "n", "k1", "k2", "bands", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, sig array<long>")


def _of_classes(docs: DataFrame, classes: DataFrame, width: int, describe: Callable[[np.ndarray, np.ndarray], pa.ListArray], name: str) -> DataFrame:
    """node and an array that ``describe`` makes of the sets (values, sizes), for classes (doc_id, node, k1, k2).

    Of rows that repeat a doc_id, those with the class's set count, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, 0):
                values, sizes = _sets(b.column(0), width)
                k1, k2 = _identity(values, sizes)
                own = (k1.view(np.int64) == b.column(2).to_numpy()) & (k2.view(np.int64) == b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(1), describe(values, sizes)], ["node", name]).filter(pa.array(own))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(classes.select("doc_id", "node", "k1", "k2"), "doc_id")
    return texts.select("text", "node", "k1", "k2").mapInArrow(run, f"node long, {name} array<long>").dropDuplicates(["node"])


def full_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """node and the whole set of shingle hashes (members) of classes."""

    def whole(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))

    return _of_classes(docs, classes, width, whole, "members")


def sharper(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """node and the sharper signature (sharp) of classes."""

    def signature(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        out = np.zeros((len(sizes), SHARP * SHARP_BITS // 64), np.uint64)
        if len(values):
            out[sizes > 0] = pack(minima(values, sizes[sizes > 0], SHARP), SHARP_BITS)
        return _lists(out, len(sizes))

    return _of_classes(docs, classes, width, signature, "sharp")


def estimate(a: Column, b: Column, k: int, bits: int) -> Column:
    """Similarity from packed low bits: equal groups of bits by bit counts, less chance collisions."""
    lowest = F.lit(sum(1 << i for i in range(0, 64, bits)) - (0 if bits > 1 else 1 << 64))

    def unequal(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for step in range(bits.bit_length() - 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1 << step))
        return F.bit_count(x.bitwiseAND(lowest))

    differ = sum((unequal(i) for i in range(1, -(-k * bits // 64))), unequal(0))
    chance = 2.0**-bits
    return (1 - differ / F.lit(float(k)) - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of the edges (a, b), as a table.

    Alternating large and small stars; the state of each round is a table in the shared folder.
    """

    def stars(e: DataFrame, n: int) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("rows"))
        large = common.unskewed(both, least, ["a"], "rows", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every node's smallest neighbour: a node that many meet at now is a root, which has no larger one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        return small.union(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = common.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "links")
    seen = state(now)
    while seen[0]:
        after = common.cut(stars(now, seen[0]).coalesce(8 + seen[0] // LINKS_A_TASK), "stars")
        common.drop(now)
        now, before, seen = after, seen, state(after)
        if before == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = common.cut(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
    common.drop(now)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: classes of documents linked by a similarity of ``percent`` or more.

    Sets are distinct shingles of ``width`` words (A-Z as a-z); a link has 100 * intersection >= percent * union,
    confirmed on full sets. ``kept`` marks the smallest doc_id of each component.
    """
    return _judged(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The columns of ``near_duplicates`` with the identity of each row's set (k1, k2) and the root of its component, null without words."""
    bands = bands_for(percent / 100)
    all_docs = common.cut(sketches(docs, width, bands), "sketches")
    same_set = all_docs.where("n > 0 and doc_id is not null").groupBy("k1", "k2")
    classes = same_set.agg(F.min(F.struct("doc_id", "n", "bands", "sig")).alias("c"), F.count("*").alias("copies"))
    classes = common.cut(classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "copies", "c.*"), "classes")
    comp, roots = _linked(docs, classes, width, percent, bands)

    first = classes.select("node", "k1", "k2", "copies", F.col("doc_id").alias("first"))
    named = common.cut(first.join(comp, "node", "left").select("k1", "k2", "copies", "first", F.coalesce("component", "node").alias("c")), "named")
    each = named.groupBy("c").agg(F.min("first").alias("least"), F.count("*").alias("rows"), F.sum("copies").alias("members"))
    each = common.cut(each.join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c")), "each")
    facts = each.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("classes"), F.coalesce(F.sum("members"), F.lit(0)).alias("documents")).first()
    smallest = each.groupBy("root").agg(F.min("least").alias("component_id"))
    told = common.cut(each.join(smallest, "root").select("c", "rows", "root", "component_id"), "told")
    own = common.cut(common.unskewed(named, told, ["c"], "rows", facts.classes).select("k1", "k2", "copies", "root", "component_id"), "own")
    common.drop(classes, comp, named, each, told, roots)

    has_class = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rows = all_docs.select("doc_id", F.col("n").alias("n_shingles"), "n", "k1", "k2")
    found = common.unskewed(rows.where(has_class), own, ["k1", "k2"], "copies", facts.documents)
    key = [F.when(F.col("n") > 0, F.col(k)).alias(k) for k in ("k1", "k2")]
    none = rows.where(~has_class | F.col("doc_id").isNull()).select("doc_id", "n_shingles", *key, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    found = found.select("doc_id", "n_shingles", "k1", "k2", "root", "component_id").union(none)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "k1", "k2", "root")


def _linked(docs: DataFrame, classes: DataFrame, width: int, percent: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """node and component of the classes (node, doc_id, n, k1, k2, bands, sig) that are linked with others, and
    the same of components (a lone class is its own) that later links make one: tables.
    """
    threshold, k = percent / 100, bands * ROWS
    exploded = classes.select("node", F.explode("bands").alias("key"))
    draw = F.struct(F.xxhash64("key", "node").alias("h"), F.col("node").alias("hub"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("members"), F.min(draw).alias("x")).where("members > 1").select("key", "members", F.col("x.hub").alias("hub"))
    shared = common.cut(shared, "keys")
    buckets = common.cut(common.unskewed(exploded, shared, ["key"], "members", classes.count() * bands).select("key", "node", "hub"), "buckets")
    common.drop(shared)

    pairs = common.cut(buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    rated = _described(pairs, classes.select("node", "n", "sig"))
    rated = rated.where(_sized(percent)).withColumn("est", estimate(F.col("sig_a"), F.col("sig_b"), k, BITS)).where(F.col("est") >= floor(threshold, k, BITS))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("est"), "b"))
    links = _confirmed(docs, classes, rated.withColumn("r", best).where(F.col("r") <= FIRST).select("a", "b"), width, percent)
    comp = components(links)
    common.drop(pairs, links)

    still = _open(buckets.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    common.drop(buckets)
    sharp = common.cut(sharper(docs, classes.join(still.select("node").distinct(), "node", "left_semi"), width).join(classes.select("node", "n", "bands"), "node"), "sharp")
    likely = _sized(percent) & (estimate(F.col("sharp_a"), F.col("sharp_b"), SHARP, SHARP_BITS) >= floor(threshold, SHARP, SHARP_BITS))
    bridges: list[DataFrame] = []

    def roots() -> DataFrame:
        """What components the links found since then make one."""
        edges = still.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)
        for found in bridges:
            edges = edges.union(found.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
        return components(edges.distinct())

    now = still
    for turn in range(ROUNDS):
        if now.isEmpty():
            break
        drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node"))
        one = common.cut(now.groupBy("key", "c").agg(drawn.alias("x")).select("key", F.col("c").alias("c_a"), F.col("x.node").alias("a")), "representatives")
        draws = [F.min(F.struct(F.xxhash64(F.lit(turn * HUBS + k), "c_a").alias("h"), F.col("a").alias("b"), F.col("c_a").alias("c_b"))) for k in range(HUBS)]
        hubs = common.cut(one.groupBy("key").agg(F.array(*draws).alias("hubs"), F.count("*").alias("rows")), "hubs")
        met = common.unskewed(one, hubs, ["key"], "rows", one.count()).select("a", "c_a", F.explode("hubs").alias("x")).select("a", "c_a", "x.b", "x.c_b")
        pairs = common.cut(met.where("a <> b").select("a", "b", "c_a", "c_b").distinct(), "pairs")
        links = _confirmed(docs, classes, _described(pairs, sharp.drop("bands")).where(likely), width, percent, ["c_a", "c_b"])
        common.drop(one, hubs, pairs)
        if links.isEmpty():
            break
        bridges.append(links)
        to = roots()
        before, now = now, _open(_renamed(still, to.toDF("c", "root")))
        common.drop(to, *([before] if before is not still else []))
    if not now.isEmpty():
        bridges.append(_confirmed(docs, classes, _across(now, sharp, likely), width, percent, ["c_a", "c_b"]))
    to = roots()
    common.drop(sharp, still, *bridges, *([now] if now is not still else []))
    return comp, to


def _sized(percent: int) -> Column:
    """Whether sets of n_a and n_b members can be similar enough."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _described(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (a, b) with the columns of both nodes; b may be the same in many of them."""
    side = lambda x: of.select(*(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in of.columns))
    often = pairs.groupBy("b").agg(F.count("*").alias("rows")).join(side("b"), "b")
    return common.unskewed(pairs, often, ["b"], "rows", pairs.count()).drop("rows").join(side("a"), "a")


def _open(members: DataFrame) -> DataFrame:
    """The members (key, node, c) of buckets that span several components, as a table."""
    members = common.cut(members, "members")
    spans = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("rows"))
    out = common.cut(common.unskewed(members, spans, ["key"], "rows", members.count()).where("lo <> hi").select("key", "node", "c"), "open")
    common.drop(members)
    return out


def _renamed(members: DataFrame, to: DataFrame) -> DataFrame:
    """The rows with their component c replaced by its root, if ``to`` (c, root) has one; a component may have many rows."""
    roots = members.groupBy("c").agg(F.count("*").alias("rows")).join(to, "c", "left")
    found = common.unskewed(members, roots, ["c"], "rows", members.count())
    return found.select("key", "node", F.coalesce("root", "c").alias("c"))


def _across(still: DataFrame, sharp: DataFrame, likely: Column) -> DataFrame:
    """Pairs (a, b) of members of a bucket in different components that look similar.

    The members of a bucket are dealt into cells of about CELL, and every two cells, or one with itself, meet by
    themselves: a task holds a few cells at a time, however large a bucket is.
    """
    sizes = still.groupBy("key").agg(F.count("*").alias("rows"))
    dealt = common.unskewed(still, sizes, ["key"], "rows", still.count()).withColumn("cells", F.ceil(F.col("rows") / CELL).cast("int"))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).join(sharp, "node")
    side = lambda x: [F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("c", "n", "sharp", "bands"))]
    first = dealt.select("key", F.col("cell").alias("lo"), F.explode(F.sequence(F.col("cell"), F.col("cells") - 1)).alias("hi"), *side("a"))
    second = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("cell"))).alias("lo"), F.col("cell").alias("hi"), *side("b"))
    once = (F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b"))
    here = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("key")  # of the buckets that both are in, one tells
    return first.join(second, ["key", "lo", "hi"]).where(once & (F.col("c_a") != F.col("c_b")) & likely & here).select("a", "b", "c_a", "c_b")


def _confirmed(docs: DataFrame, classes: DataFrame, candidates: DataFrame, width: int, percent: int, more: Sequence[str] = ()) -> DataFrame:
    """Those of the candidate pairs (a, b and more columns) of classes whose full sets are similar enough, as a table.

    A set that many pairs want is copied, so that each copy meets with a thousandth of all pairs at most.
    """
    c = common.cut(candidates.select("a", "b", *more), "candidates")
    total = c.count()
    wanted = c.select(F.col("a").alias("node")).union(c.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(docs, classes.join(wanted, "node", "left_semi"), width)

    def with_sets(x: DataFrame, side: str, other: str) -> DataFrame:
        own = sets.select(F.col("node").alias(side), F.col("members").alias(f"of_{side}"))
        rows = c.groupBy(side).agg(F.count("*").alias("rows")).where(common.often(F.col("rows"), total))
        parts = common.partitions_for(docs.sparkSession)  # sets take long to compare for their size, so tasks aren't merged
        if rows.isEmpty():
            return x.repartition(parts, side).join(own, side)
        often = F.broadcast(rows.select(side, F.ceil(F.col("rows") * common.HOT / total).cast("int").alias("copies")))
        copies = F.coalesce("copies", F.lit(1))
        own = own.join(often, side, "left").select(side, f"of_{side}", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
        dealt = x.join(often, side, "left").withColumn("copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("copies")
        return dealt.repartition(parts, side, "copy").join(own, [side, "copy"]).drop("copy")

    x = with_sets(with_sets(c, "a", "b"), "b", "a")
    both = F.size(F.array_intersect("of_a", "of_b"))
    out = common.cut(x.where(both * 100 >= (F.size("of_a") + F.size("of_b") - both) * percent).select("a", "b", *more), "confirmed")
    common.drop(c)
    return out


def _with_identity(docs: DataFrame, width: int) -> DataFrame:
    """The rows with their doc_id as __id and the identity of their sets as __k1 and __k2, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, "text"):
                values, sizes = _sets(b.column("text"), width)
                keys = [pa.array(k.view(np.int64), mask=sizes == 0) for k in _identity(values, sizes)]
                yield pa.RecordBatch.from_arrays([*b.columns, *keys], [*b.schema.names, "__k1", "__k2"])

    schema = StructType([*docs.schema.fields, StructField("__k1", LongType()), StructField("__k2", LongType())])
    return docs.mapInArrow(run, schema).withColumn("__id", F.col("doc_id").cast("long"))


def clean(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class of near duplicates; rows without a doc_id stay.

    Rows that repeat a doc_id are told apart by their sets: one stays of those linked to each other, those linked with
    a smaller doc_id go, and texts without words count as equal. Of rows with equal sets any may be the one that stays.
    """
    found = common.cut(_judged(docs, width, percent).where("doc_id is not null").select("doc_id", "kept", "k1", "k2", "root"), "near")
    total = found.count()
    ids = found.groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    ids = common.cut(ids.where("not __kept or __rows > 1"), "dropped")
    own = docs.withColumn("__id", F.col("doc_id").cast("long"))
    marked = common.unskewed(own.where("__id is not null"), ids, ["__id"], "__rows", total, "left")
    single = marked.where("__rows is null").select(*docs.columns).union(own.where("__id is null").select(*docs.columns))
    several = ids.where("__kept and __rows > 1").select("__id", "__rows")
    kept = common.unskewed(found.where("kept").withColumnRenamed("doc_id", "__id"), several, ["__id"], "__rows", total, "left_semi")
    chosen = kept.groupBy("__id", "root").agg(F.min(F.struct("k1", "k2")).alias("k")).select(F.col("__id").alias("__of"), F.col("k.k1").alias("__c1"), F.col("k.k2").alias("__c2"))
    repeated = _with_identity(marked.where("__kept and __rows > 1").select(*docs.columns), width).dropDuplicates(["__id", "__k1", "__k2"])
    same = (F.col("__id") == F.col("__of")) & F.col("__k1").eqNullSafe(F.col("__c1")) & F.col("__k2").eqNullSafe(F.col("__c2"))
    return single.union(repeated.join(chosen, same, "left_semi").select(*docs.columns))
