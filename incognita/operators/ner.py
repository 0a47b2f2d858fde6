"""Chunks of a text and named-entity backends.

A backend gives an array of (start, end, label, score) for a text: annotations computed elsewhere, patterns, or a model
in Python workers.
"""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import spans

log = logging.getLogger(__name__)
ANNOTATIONS = "array<struct<start:int,end:int,label:string,score:double>>"
CHUNKS = "array<struct<text:string,start:int,end:int>>"
# Patterns of the heuristic backend, by label.
HEURISTICS = {
    "PER": r"\b[A-Z][a-z]+ [A-Z]{2,}\b",
    "LOC": r"\b(?:[Rr]ue|[Aa]venue|[0-9]{5}) [A-Z][a-z]+\b",
    "ORG": r"\b[A-Z]{2,} [A-Z][a-z]+\b",
}
HEURISTIC_SCORE = 0.5
#: What a text must hold for a heuristic pattern to match at all; plain ASCII classes are quick to look for.
GUARDS = {"PER": " [A-Z]{2}", "LOC": "[Rr]ue |[Aa]venue |[0-9]{5} ", "ORG": "[A-Z]{2} "}


def whitespace_tokens(sentence: Column) -> Column:
    """The default token count of a sentence: its words."""
    return F.size(F.regexp_extract_all(sentence, F.lit(r"(?U)\S+"), F.lit(0)))


def chunks(text: Column, max_tokens: int = 400, overflow: int = 50, tokens: Callable[[Column], Column] = whitespace_tokens) -> Column:
    """Sentences (parted by ". ") packed greedily into chunks.

    A chunk takes sentences while it has fewer than ``max_tokens`` tokens and would not pass ``max_tokens + overflow``; a
    long sentence is never cut. A chunk that doesn't end with a full stop gets one, and offsets advance by the chunk's
    length and one more while sentences remain.
    """
    zero = F.struct(F.array().cast(CHUNKS).alias("out"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def closed(acc: Column, more: bool) -> Column:
        ended = F.when(acc["now"].endswith("."), acc["now"]).otherwise(F.concat(acc["now"], F.lit(".")))
        piece = F.struct(ended.alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(ended)).alias("end"))
        return F.struct(F.concat(acc["out"], F.array(piece)).alias("out"), (acc["at"] + F.length(ended) + int(more)).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        size = s["n"]
        full = acc["now"].isNotNull() & ((acc["n"] >= max_tokens) | (acc["n"] + size > max_tokens + overflow))
        done = closed(acc, True)
        begun = F.struct(done["out"].alias("out"), s["s"].alias("now"), size.alias("n"), done["at"].alias("at"))
        joined = F.when(acc["now"].isNull(), s["s"]).otherwise(F.concat_ws(". ", acc["now"], s["s"]))
        added = F.struct(acc["out"].alias("out"), joined.alias("now"), (acc["n"] + size).alias("n"), acc["at"].alias("at"))
        return F.when(full, begun).otherwise(added)

    sentences = F.transform(F.split(text, r"\. ", -1), lambda s: F.struct(s.alias("s"), tokens(s).alias("n")))
    return F.aggregate(sentences, zero, step, lambda acc: closed(acc, False)["out"])


def sentences(text: Column) -> Column:
    """Chunks of one sentence each, sought from the sum of the lengths of those before (white space between them left out)."""
    zero = F.struct(F.array().cast(CHUNKS).alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        found = F.call_function("locate", s, text, acc["at"])
        piece = F.struct(s.alias("text"), (found - 1).alias("start"), (found - 1 + F.length(s)).alias("end"))
        return F.struct(F.concat(acc["out"], F.array(piece)).alias("out"), (acc["at"] + F.length(s)).alias("at"))

    return F.aggregate(F.filter(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: s != ""), zero, step, lambda acc: acc["out"])


def heuristic(text: Column, patterns: dict[str, str] = HEURISTICS) -> Column:
    """Annotations by patterns."""

    def labelled(label: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label"), F.lit(HEURISTIC_SCORE).alias("score"))

    none = F.array().cast(ANNOTATIONS)

    def of(label: str, pattern: str) -> Column:
        found = F.transform(spans(text, F.lit(f"(?U){pattern}")), labelled(label)).cast(ANNOTATIONS)
        return F.when(text.rlike(GUARDS[label]), found).otherwise(none) if patterns is HEURISTICS else found

    found = [of(label, p) for label, p in patterns.items()]
    return F.concat(*found).cast(ANNOTATIONS)


Model = Callable[[list[str]], list[list[dict]]]


def _found(model: Model, text: str, at: int) -> list[tuple[int, int, str, float]]:
    """A chunk's annotations with the document's offsets; none if the model fails on it."""
    try:
        found = model([text])[0]
    except Exception:  # noqa: BLE001 - a chunk's failure isn't the document's
        log.warning("the model failed on a chunk of %d characters", len(text), exc_info=True)
        return []
    return [(at + int(e["start"]), at + int(e["end"]), e["entity_group"], float(e.get("score", 0.0))) for e in found if e.get("start") is not None and e.get("end") is not None]


def by_model(chunked: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """(doc_id, start, end, label, score) of chunks (doc_id, chunk_text, chunk_start) by a model.

    ``load`` is called once in a Python worker's task and gives a function from texts to annotations (entity_group, start,
    end, score); offsets are moved to the document. A chunk that the model fails on has no annotations.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            out = [(doc, *e) for doc, text, at in zip(b["doc_id"], b["chunk_text"], b["chunk_start"]) for e in _found(model, text, at)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "label", "score"])

    return chunked.select("doc_id", "chunk_text", "chunk_start").mapInPandas(run, "doc_id long, start int, end int, label string, score double")


def model_backend(load: Callable[[], Model], cut: Callable[[Column], Column] = chunks) -> Callable[[Column], Column]:
    """A backend for ``Engine`` from a model: texts are cut into chunks, annotated in Python workers, offsets moved.

    ``load`` is as in ``by_model``; documents stay rows and nothing is joined. A null text has no annotations.
    """

    @F.pandas_udf(ANNOTATIONS)
    def annotate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series([[e for c in (pieces if pieces is not None else []) for e in _found(model, c["text"], int(c["start"]))] for pieces in b], dtype=object)

    return lambda text: annotate(cut(text))


def transformer(name: str) -> Callable[[], Model]:
    """The loader of a token-classification model of the ``transformers`` package, by name or folder.

    The package is imported in the workers, where the model runs.
    """

    def load() -> Model:
        from transformers import pipeline

        return pipeline("token-classification", model=name, aggregation_strategy="simple")

    return load


def loader(spec: str) -> Callable[[], Model]:
    """The loader that a command line names: ``module:function`` of this installation, else a transformer's name."""
    module, colon, function = spec.partition(":")
    return getattr(importlib.import_module(module), function) if colon else transformer(spec)


def annotated(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """The documents with the column ``ner``: a table of annotations (doc_id, start, end, label, score), in order of start."""
    each = annotations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).cast(ANNOTATIONS).alias("ner"))
    return docs.join(each, "doc_id", "left").withColumn("ner", F.coalesce("ner", F.array().cast(ANNOTATIONS)))
