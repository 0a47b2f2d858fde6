"""Language identification by fusing evidence in Bayes' way.

The posterior of a language is the product of
- the text's likelihood under the language's byte trigrams, tempered since neighbouring trigrams aren't independent,
  with a language "other" whose trigrams are all alike;
- the declared (markup) language, which is right with a chance of ``TRUST``;
- the address suffix, through the shares of languages seen under it;
- the prior of the host, smoothed towards its registered domain, that towards the suffix and that towards all documents.
Suffix shares and host priors come from one grouped aggregation of the text posteriors (sums of probabilities, so the
counts are whole and add up before they are shuffled). A registered domain has two labels, or three where a short label
such as "co" stands before a country's. Hosts with many rows are joined apart, rows without a host not at all.

Trigram likelihoods are fitted on a bounded sample of the rows of each label (``train_rows``, drawn by a hash of id and
text), so a label's share of the table doesn't matter; all documents count for priors, and all texts are read whole.

A document is rejected if it has no letter or if "other" wins. Edge cases: null text counts as empty and is rejected;
null or unknown declarations, hosts and ids are no evidence; declarations count by their primary subtag ("en" of "en-US");
ties go to the language that sorts first; rows that repeat an id are judged each; without labelled rows everything with a letter is kept as "other"; an empty table gives an
empty result; further columns, such as clashing names, are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TABLE = 1 << 16
#: Rows of each label that its trigrams are fitted on.
TRAIN_ROWS = 6000
#: Trigrams without which a label's sample says too little.
LEAST_TRIGRAMS = 300
#: Hashes are drawn in so many steps.
DRAWS = 1 << 40
#: Part of a trigram's log-likelihood that counts as independent evidence.
TEMPER = 0.25
#: The most that the text alone may say for or against a language, in nats.
CERTAIN = 30.0
TRUST = 0.9
#: Observations that a level's parent stands for when its shares are smoothed.
WEIGHT = 20.0
OTHER = "other"
_CASE = np.arange(256, dtype=np.uint8)
_CASE[65:91] += 32
_CASE[[*range(9, 14)]] = 32
_PLAIN = np.zeros(256, bool)
_PLAIN[[32, *range(97, 123), *range(128, 256)]] = True


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of the trigrams of letters and spaces of all texts, and the number for each text."""
    data = b"\n\n".join([b"", *((t or "").encode("utf-8", "surrogatepass") for t in texts), b""])
    x = _CASE[np.frombuffer(data, np.uint8)]
    ends = np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 2 for t in texts]) if texts else np.zeros(0, np.int64)
    plain = _PLAIN[x]
    good = plain[:-2] & plain[1:-1] & plain[2:] & ~((x[:-2] == 32) & (x[1:-1] == 32)) & ~((x[1:-1] == 32) & (x[2:] == 32))
    at = np.flatnonzero(good)
    wide = x.astype(np.uint32)
    slot = ((wide[at] * 65536 + wide[at + 1] * 256 + wide[at + 2]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    edges = np.searchsorted(at, np.concatenate([[0], ends]))
    return slot, np.diff(edges)


class Model:
    """Log-likelihoods of trigrams, one row a slot and one column a language; the last column is "other"."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, OTHER]
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * TABLE)
        self.table = np.log(np.vstack([p, np.full((1, TABLE), 1 / TABLE)])).T.astype(np.float32).copy()

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Tempered log-likelihood of each text in each language, relative to the best."""
        out = np.zeros((len(texts), len(self.languages)))
        slot, n = trigrams(texts)
        some = n > 0
        if some.any():
            starts = np.concatenate([[0], np.cumsum(n)])[:-1][some]
            for k in range(len(self.languages)):
                out[some, k] = np.add.reduceat(self.table[slot, k], starts, dtype=np.float64)
        out *= TEMPER
        return np.maximum(out - out.max(axis=1, keepdims=True), -CERTAIN)


def primary(declared: Column) -> Column:
    """The primary subtag of a declared language, lower-cased; what is no tag stays as it is, trimmed."""
    low = F.lower(F.trim(declared))
    return F.coalesce(F.nullif(F.regexp_extract(low, r"^([a-z]{2,3})[-_]", 1), F.lit("")), low)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Trigram counts of a sample of about ``train_rows`` rows (id, text, label) of each label, added up by language.

    Rows without a letter aren't drawn, so that a label's sample has text wherever the label has.
    """
    spark = labelled.sparkSession
    rows = labelled.where("label is not null and trim(label) <> ''").where(F.col("text").rlike(r"\p{L}")).select("id", "text", primary(F.col("label")).alias("label"))
    # A text has at most two trigrams more than bytes.
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 2).alias("most")).where(F.col("most") >= LEAST_TRIGRAMS).collect()
    labels = sorted(r.label for r in sizes)
    index = {label: k for k, label in enumerate(labels)}
    below = spark.createDataFrame([(r.label, index[r.label], int(min(1.0, train_rows / r.n) * DRAWS)) for r in sizes], "label string, k int, below long")
    sample = rows.join(F.broadcast(below), "label").where(F.pmod(F.xxhash64("id", "text"), F.lit(DRAWS)) < F.col("below")).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def added() -> Iterator[pa.RecordBatch]:
            for k, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["k", "slot", "n"])
            sums.clear()

        for whole in batches:
            for b in common.slices(whole, 1):
                by: dict[int, list[str]] = {}
                for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by.setdefault(k, []).append(text)
                for k, texts in by.items():
                    sums[k] = sums.get(k, 0) + np.bincount(trigrams(texts)[0], minlength=TABLE)
                    if len(sums) >= 100:
                        yield from added()
        yield from added()

    sums = sample.mapInArrow(count, "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toArrow()
    k, slot, n = (sums[name].to_numpy() for name in ("k", "slot", "n"))
    enough = np.flatnonzero(np.bincount(k, n, minlength=len(labels)) >= LEAST_TRIGRAMS)
    counts = np.zeros((len(enough), TABLE))
    at = np.full(len(labels) + 1, -1)
    at[enough] = np.arange(len(enough))
    held = at[k] >= 0
    counts[at[k[held]], slot[held]] = n[held]
    return Model([labels[x] for x in enough], counts)


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased, without port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute; null where it declares none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1)), F.lit(""))


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and markup."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[#\w]+;?", " ")


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """The rows (id, text, declared, host and others) with language, posterior and kept.

    ``host`` is any name with dots, most special label first; its last label is the address suffix.
    """
    languages = model.languages
    names = [f"p{k}" for k in range(len(languages))]
    letter = re.compile(r"[^\W\d_]")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, "text"):
                texts = b.column("text").to_pylist()
                e = model.evidence(texts)
                has = [bool(letter.search(t or "")) for t in texts]
                yield pa.RecordBatch.from_arrays([*(c for name, c in zip(b.schema.names, b.columns) if name != "text"), pa.array(has, pa.bool_()), *(pa.array(e[:, k]) for k in range(len(names)))], [*(x for x in b.schema.names if x != "text"), "has_letter", *names])

    head = rows.select("id", primary(F.col("declared")).alias("declared"), F.lower("host").alias("host"), "text")
    kinds = ", ".join(["id long, declared string, host string, has_letter boolean", *(f"{n} double" for n in names)])
    scored = common.cut(head.withColumn("id", F.col("id").cast("long")).mapInArrow(score, kinds), "evidence")

    total = sum((F.exp(n) for n in names[1:]), F.exp(names[0]))
    share = lambda n: F.sum(F.when(F.col("has_letter"), F.exp(n) / total).otherwise(0.0)).alias(n)
    shares = scored.where("host is not null").groupBy("host").agg(*(share(n) for n in names), F.count("*").alias("rows"))
    labels = F.split("host", r"\.")
    suffix, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    parts = F.when((F.length(suffix) == 2) & (F.length(second) <= 3), 3).otherwise(2)
    domain = F.array_join(F.slice(labels, -F.least(parts, F.size(labels)), F.size(labels)), ".")
    shares = common.cut(shares.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    hosts, placed, *sums = shares.agg(F.count("*"), F.sum("rows"), *(F.sum(n) for n in names)).first()

    def smoothed(own: list[Column], parent: list[Column]) -> list[Column]:
        n = sum(own[1:], own[0])
        return [(o + WEIGHT * p) / (n + WEIGHT) for o, p in zip(own, parent)]

    overall = sum(x or 0.0 for x in sums)
    flat = 1 / len(names)
    whole = [((x or 0.0) + WEIGHT * flat) / (overall + WEIGHT) for x in sums]
    level = lambda key, prefix: shares.groupBy(key).agg(*(F.sum(n).alias(f"{prefix}{n}") for n in names), F.count("*").alias(f"of_{key}"))
    wide = common.unskewed(shares, level("suffix", "s"), ["suffix"], "of_suffix", hosts)
    wide = common.unskewed(wide, level("domain", "d"), ["domain"], "of_domain", hosts)
    of_suffix = smoothed([F.col(f"s{n}") for n in names], [F.lit(w) for w in whole])
    of_domain = smoothed([F.col(f"d{n}") for n in names], of_suffix)
    of_host = smoothed([F.col(n) for n in names], of_domain)
    priors = wide.select("host", "rows", *(F.log(h).alias(f"h{n}") for h, n in zip(of_host, names)), *(F.log(s / w).alias(f"t{n}") for s, w, n in zip(of_suffix, whole, names)))
    priors = common.cut(priors, "priors")
    common.drop(shares)

    known = F.col("declared").isin(languages[:-1])
    others = max(1, len(names) - 2)

    def log_posterior(k: int) -> Column:
        said = F.when(known, F.when(F.col("declared") == languages[k], float(np.log(TRUST))).otherwise(float(np.log((1 - TRUST) / others)))).otherwise(0.0) if languages[k] != OTHER else F.when(known, float(np.log(1 / max(1, len(names) - 1)))).otherwise(0.0)
        return F.col(names[k]) + said + F.coalesce(f"h{names[k]}", F.lit(float(np.log(whole[k])))) + F.coalesce(f"t{names[k]}", F.lit(0.0)) * 0.5

    hosted = common.unskewed(scored.where("host is not null"), priors, ["host"], "rows", placed or 0)
    joined = hosted.unionByName(scored.where("host is null"), allowMissingColumns=True)
    scores = joined.select("id", "has_letter", *(log_posterior(k).alias(f"q{k}") for k in range(len(names))))
    q = [F.col(f"q{k}") for k in range(len(names))]
    best = F.greatest(*q, F.lit(-1e300))
    norm = sum((F.exp(c - best) for c in q[1:]), F.exp(q[0] - best))
    pick = F.coalesce(*(F.when(c == best, F.lit(n)) for c, n in zip(q, languages)))
    language = F.when(F.col("has_letter"), pick).otherwise(OTHER)
    kept = F.col("has_letter") & ((language != OTHER) | F.lit(len(languages) == 1))
    return scores.select("id", language.alias("language"), F.when(F.col("has_letter"), 1 / norm).otherwise(0.0).alias("posterior"), kept.alias("kept"))


def _documents(docs: DataFrame, key: Column, train_rows: int) -> DataFrame:
    rows = docs.select(key.alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    return identify(rows, fit(rows.select("id", "text", F.col("declared").alias("label")), train_rows))


def of_documents(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id, language, posterior, kept of documents: ``lang`` is the label and the declaration, ``source`` the host."""
    return _documents(docs, F.col("doc_id").cast("long"), train_rows)


def of_pages(pages: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id, language, posterior, kept of web pages: the declaration is the markup's, the host that of the address."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), visible(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))
    return identify(rows, fit(rows.select("id", "text", F.col("declared").alias("label")), train_rows))


def clean(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that aren't rejected; rows are told apart by doc_id and text, and stay if one of them is kept."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    verdicts = _documents(docs, key, train_rows).groupBy(F.col("id").alias("__key")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    total = docs.count()
    told = common.cut(verdicts.where(~F.col("__kept") | common.often(F.col("__rows"), total)), "rejected")
    marked = common.unskewed(docs.withColumn("__key", key), told, ["__key"], "__rows", total, "left")
    return marked.where("__kept is null or __kept").select(*docs.columns)
