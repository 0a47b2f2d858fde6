"""The entity: its fields, and how expressions build and change it.

Entities of a document are an array of structs; its first two fields, ``start`` and ``seq``, order them as the detectors
emitted them. Operators are functions of an entity (a struct column or a lambda's argument) and the document's text, so
that the same expression runs inside a document's array without a shuffle, or over exploded rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "start": "int",
    "seq": "int",
    "end": "int",
    "text": "string",
    "label": "string",
    "source": "string",
    "category": "string",
    "score": "double",
}
ENTITY = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
ENTITIES = f"array<{ENTITY}>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entity(**fields: Column) -> Column:
    """An entity; fields that aren't given are null."""
    return F.struct(*(fields.get(k, F.lit(None)).cast(v).alias(k) for k, v in FIELDS.items()))


def changed(e: Column, **fields: Column) -> Column:
    """The entity with some fields replaced."""
    return F.struct(*((fields[k].cast(v) if k in fields else e[k]).alias(k) for k, v in FIELDS.items()))


def none() -> Column:
    """No entities."""
    return F.array().cast(ENTITIES)


def numbered(entities: Column) -> Column:
    """The entities with ``seq`` set to their places."""
    return F.transform(entities, lambda e, i: changed(e, seq=i))


def slice_of(text: Column, e: Column) -> Column:
    """What the document's text has at the entity's place."""
    return F.substring(text, e["start"] + 1, e["end"] - e["start"])


def rows(docs: DataFrame, *more: str) -> DataFrame:
    """One row for each entity of the column ``entities``: doc_id, the entity's fields and ``more`` columns."""
    exploded = docs.select("doc_id", *more, F.explode("entities").alias("e"))
    return exploded.select("doc_id", *more, *(F.col(f"e.{k}").alias(k) for k in FIELDS))
