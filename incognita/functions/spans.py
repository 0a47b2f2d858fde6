"""Regular-expression matches with their places, as expressions: Spark has no such function of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"


#: Matches that are placed one after the other before their block is put away, so that no array grows by copying to a
#: text's whole number of matches.
_BLOCK = 512


def spans(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, text>> of the pattern's matches from left to right, in code points, end exclusive.

    The lengths of the texts between matches and of the matches add up to their places. The pattern may be a column; it
    must not match the empty string. A null text has no matches.
    """
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    none = F.array().cast("array<int>")

    def placed(f: Column) -> Column:
        m, gaps = f["m"], f["gaps"]

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(m, i))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.get(m, i).alias("text")))).alias("out"))

        def block(acc: Column, first: Column) -> Column:
            zero = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
            order = F.sequence(first, F.least(first + _BLOCK, F.size(m)) - 1)
            return F.aggregate(order, zero, step, lambda b: F.struct(b["at"].alias("at"), F.concat(acc["out"], F.array(b["out"])).alias("out")))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        blocks = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1, F.lit(_BLOCK))).otherwise(none)
        return F.aggregate(blocks, zero, block, lambda acc: F.flatten(acc["out"]))

    return F.element_at(F.transform(F.array(found), placed), 1)


#: Texts of these characters alone part into words as ``_GAP`` says; others take the slower Unicode classes.
_LATIN = r"^[\x{0}-\x{24F}\x{2000}-\x{200B}\x{2010}-\x{2027}\x{2030}-\x{203E}\x{20AC}]*$"
_GAP = r"[\x{0}-/:-@\[-^`{-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{D7}\x{F7}\x{2000}-\x{20AC}]+"
#: Words that stand for what a text holds: two digits side by side, an at sign, what accented letters become if misread.
DIGITS, AT, MISREAD = "#digits", "#at", "#misread"
_MISREAD = "[ÃãÅå‰©]"


def words_of(text: Column) -> Column:
    """The distinct lower-cased words of a text, as word boundaries part them."""
    low = F.lower(text)
    return F.array_distinct(F.when(text.rlike(_LATIN), F.split(low, _GAP)).otherwise(F.split(low, r"(?U)\W+")))


def hits(text: Column, anchors: list[str]) -> Column:
    """Those of the anchors that a text holds: words and the signs."""
    words = F.array_intersect(words_of(text), F.lit(sorted(anchors)).cast("array<string>"))
    signs = F.array(F.when(text.rlike(r"\p{Nd}{2}"), DIGITS), F.when(F.contains(text, F.lit("@")), AT), F.when(text.rlike(_MISREAD), MISREAD))
    return F.concat(words, F.array_compact(signs))
