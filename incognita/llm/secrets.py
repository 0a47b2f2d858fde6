"""Secret scans: fixed credential patterns, and values of credential contexts rated by the cost of guessing them.

The base patterns (assignments, access keys, long hexadecimal runs) are reported as they match. Beyond them, values in
further credential contexts (a wider list of key words, an optional verb, quoted or bare values of any length) are
segmented by dynamic programming into common words, dates, repeats, keyboard walks and brute-force spans, so that the
product of the spans' guess counts, times the orders of as many spans, is least. Words are ranked: those that open guessing
lists, then the words of a public vocabulary in its order (``vocabulary``, a path); a longer stretch of letters that reads
as a word but isn't listed costs ``UNLISTED`` guesses. A value that costs ``STRONG`` guesses or more is a secret as well,
unless it is digits alone. Prose after a colon isn't: words that stand apart cost nothing.

Edge cases: null text counts as empty and has no spans; texts are scanned whole; overlapping spans of different kinds are
all reported, save values that a base span holds whole; rows that repeat a doc_id are scanned each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}

CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|auth|bearer|credential|(?:api|access|private|secret|client|signing)[_-]?(?:key|secret|token))s?["']?(?:\x20*[:=]\x20*|\x20+(?:is|was)\x20+)(?:["']([^"'\s]{6,})["']|([^\s"',;<>]{6,}))""",
    re.I | re.A,
)
#: log10 of the guesses from which a value counts as a secret.
STRONG = 10.0
#: Characters of the longest value whose verdict is remembered.
REMEMBERED = 128
#: Guesses for a word of ``WORDLIKE`` letters or more that no list has.
UNLISTED = 1e6
WORDLIKE = 8

# Words that open most guessing lists, commonest first.
WORDS = """password admin user login welcome letmein secret dragon monkey master shadow sunshine princess football baseball
superman batman trustno iloveyou qwerty abc love hello freedom whatever michael jordan hunter ranger buster soccer hockey
killer george charlie andrew michelle jessica pepper daniel access joshua maggie starwars silver william dallas yankees
hammer summer winter spring autumn corvette test guest root default changeme public private server system service account
token key api auth pass word data base home work email mail web site house world time life money star blue green black white
red orange apple banana cookie computer internet network phone mobile king queen angel baby flower purple rainbow tiger lion
eagle wolf bear horse happy lucky magic power super mega ultra""".split()
# Rows of keys as they lie side by side.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@30157$", "aaeoists")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def vocabulary(path: str) -> list[str]:
    """The words of three letters a-z or more of a vocabulary file with word ends, commonest first."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    return [w[:-4] for w, _ in sorted(ids.items(), key=lambda x: x[1]) if re.fullmatch("[a-z]{3,}</w>", w)]


def brute_cost(s: str) -> float:
    """log10 of the guesses for a span tried by brute force: the kinds of characters it uses, to its length."""
    kinds = (10 if any(c.isdigit() for c in s) else 0) + (26 if any(c.islower() for c in s) else 0) + (26 if any(c.isupper() for c in s) else 0) + (33 if any(not c.isalnum() for c in s) else 0)
    return len(s) * math.log10(max(kinds, 10))


def _repeats(value: str, width: int) -> Iterator[tuple[int, int, str, float]]:
    i, n = 0, len(value)
    while i + 2 * width <= n:
        j = i + width
        while j < n and value[j] == value[j - width]:
            j += 1
        times = (j - i) // width
        if times >= (3 if width == 1 else 2):
            yield i, i + times * width, "repeat", brute_cost(value[i : i + width]) + math.log10(times)
            i += (times - 1) * width
        i += 1


def _walks(value: str, low: str) -> Iterator[tuple[int, int, str, float]]:
    i, n = 0, len(value)
    while i < n:
        j, turns, way = i + 1, 0, None
        while j < n and (low[j - 1], low[j]) in NEXT:
            step = ord(low[j]) > ord(low[j - 1])
            turns += way is not None and step != way
            way, j = step, j + 1
        if j - i >= 4:
            yield i, j, "walk", math.log10(len(ROWS) * 10) + math.log10(j - i) + turns * math.log10(4)
        i = max(i + 1, j - 1) if j - i >= 4 else i + 1


# Pieces of identifiers and prose by their case, vowels, and signs that go between words.
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\x00-\x7f]+|[^A-Za-z\x80-\U0010ffff]+")
_VOWEL = re.compile(r"[aeiouy]", re.I)
_CLUSTER = re.compile(r"[^aeiouy]{5}|[aeiouy]{5}", re.I)
SIGNS = "-_./:,;?=&()@[]{}|+*'\"`\\"


def _unread(value: str, reads: Callable[[str, bool], bool]) -> str:
    """A value less its pieces that ``reads`` (piece, whether it stands alone) takes for words, and signs beside them."""
    pieces = ["", *_PIECE.findall(value), ""]
    letters = [p[:1].isalpha() for p in pieces]
    read = [letters[k] and reads(p, not letters[k - 1] and not letters[k + 1]) if p else False for k, p in enumerate(pieces)]
    out = []
    for k in range(1, len(pieces) - 1):
        if not letters[k]:
            p = pieces[k].lstrip(SIGNS) if read[k - 1] else pieces[k]
            out.append(p.rstrip(SIGNS) if read[k + 1] else p)
        elif not read[k]:
            out.append(pieces[k])
    return "".join(out)


def _is_prose(piece: str, alone: bool) -> bool:
    """Whether a piece of a value without digits reads as a word, in any language: one letter in six is a vowel.

    A short one must stand alone.
    """
    vowels = len(_VOWEL.findall(piece))
    return not piece.isascii() or (alone and len(piece) <= 5) or (len(piece) >= 3 and (alone or not piece.isupper()) and vowels > 0 and 6 * vowels >= len(piece))


def _wordlike(piece: str) -> bool:
    """Whether a piece of some length has vowels and consonants in turn, as words have."""
    return len(piece) >= WORDLIKE and (not piece.isascii() or (0.25 <= len(_VOWEL.findall(piece)) / len(piece) <= 0.65 and not _CLUSTER.search(piece)))


def _unlisted(value: str) -> Iterator[tuple[int, int, str, float]]:
    """Pieces that read as words."""
    for m in _PIECE.finditer(value):
        if m[0][0].isalpha() and _wordlike(m[0]):
            yield m.start(), m.end(), "word", math.log10(UNLISTED) + (0 if m[0].islower() else math.log10(2))


def _kinds(s: str) -> int:
    return any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s) + any(not c.isalnum() for c in s)


def _runs(value: str, low: str) -> tuple[Iterator[tuple[int, int, str, float]], ...]:
    """Repeats, keyboard walks and words that aren't listed, each by start."""
    return *(_repeats(value, width) for width in (1, 2, 3, 4)), _walks(value, low), _unlisted(value)


_WORDS_OF = re.compile(r"pass|pwd|secret|token|auth|bearer|credential|key", re.I | re.A)
_RUNS = re.compile(r"[0-9a-f]{24,}")


class Guesser:
    """Costs and verdicts under a ranking of words; ``words`` come after those that open guessing lists."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}
        self.longest = max(map(len, self.rank))
        self._remembered = lru_cache(maxsize=1 << 14)(self.costs_strong)

    def _told(self, value: str, low: str, plain: str, i: int) -> Iterator[tuple[int, int, str, float]]:
        """Listed words and dates that start at i; ``low`` is the value lower-cased, ``plain`` that without look-alikes."""
        for j in range(i + 3, min(len(value), i + self.longest) + 1):
            cost = 0.0
            rank = self.rank.get(low[i:j])
            if not rank and (rank := self.rank.get(plain[i:j])):
                cost += math.log10(2 * sum(a != b for a, b in zip(low[i:j], plain[i:j])) or 1)
            if rank:
                case = value[i:j]
                cost += math.log10(rank) + (0 if case.islower() or not case.isalpha() else math.log10(2) if case.isupper() or case[1:].islower() else math.log10(2 ** sum(c.isupper() for c in case)))
                yield i, j, "word", max(cost, math.log10(2))
        if m := DATE.match(value, i):
            yield i, m.end(), "date", math.log10(200 * (366 if m.end() - i > 4 else 1))

    def span_costs(self, value: str) -> list[tuple[int, int, str, float]]:
        """All spans (start, end, kind, log10 of guesses) that a guesser has a name for."""
        low = value.lower()
        plain = low.translate(LEET)
        return [*(span for i in range(len(value)) for span in self._told(value, low, plain, i)), *(span for kind in _runs(value, low) for span in kind)]

    def guess_cost(self, value: str) -> tuple[float, tuple[tuple[int, int, str], ...]]:
        """log10 of the guesses of the cheapest segmentation, and its spans.

        A segmentation of k spans costs k! times the product of its spans' guesses; neighbouring brute-force spans would be one.
        """
        n = len(value)
        ending: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
        for i, j, kind, cost in self.span_costs(value):
            ending[j].append((i, kind, cost))
        best: list[dict[tuple[int, bool], tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
        best[0][0, False] = (0.0, None)
        for j in range(1, n + 1):
            found = best[j]
            for i, kind, cost in [*ending[j], *((i, "brute", brute_cost(value[i:j])) for i in range(j))]:
                brute = kind == "brute"
                for (k, was_brute), (total, _) in best[i].items():
                    if brute and was_brute:
                        continue
                    key, new = (k + 1, brute), total + cost
                    if key not in found or new < found[key][0]:
                        found[key] = (new, (i, kind, (k, was_brute)))
        cost, key = min((math.log10(math.factorial(k)) + total, (k, b)) for (k, b), (total, _) in best[n].items())
        spans, j = [], n
        while best[j][key][1] is not None:
            i, kind, key = best[j][key][1]
            spans.append((i, j, kind))
            j = i
        return cost, tuple(reversed(spans))

    def costs_strong(self, value: str) -> bool:
        """Whether ``guess_cost`` of a value is ``STRONG`` or more, in linear time at any length.

        No cost falls as spans are added, so a beginning that costs STRONG is given up: more than 13 spans do by their orders,
        ten characters by brute force by themselves. Once no beginning is left, the rest of the value isn't looked at.
        """
        n, low = len(value), value.lower()
        plain = low.translate(LEET)
        runs = heapq.merge(*_runs(value, low), key=lambda span: span[0])
        ahead = next(runs, None)
        live: dict[int, dict[tuple[int, bool], float]] = {0: {(0, False): 0.0}}
        for i in range(n):
            if not live:
                return True
            starting = []
            while ahead and ahead[0] == i:
                starting.append((ahead[1], False, ahead[3]))
                ahead = next(runs, None)
            if not (states := live.pop(i, None)):
                continue
            starting += [(j, False, cost) for _, j, _, cost in self._told(value, low, plain, i)]
            for j in range(i + 1, n + 1):
                if (cost := brute_cost(value[i:j])) >= STRONG:
                    break
                starting.append((j, True, cost))
            for (k, was_brute), total in states.items():
                orders = math.log10(math.factorial(k + 1))
                for j, brute, cost in starting:
                    new = total + cost
                    if not (brute and was_brute) and orders + new < STRONG:
                        found = live.setdefault(j, {})
                        found[k + 1, brute] = min(new, found.get((k + 1, brute), math.inf))
        return n not in live

    def is_strong(self, value: str) -> bool:
        """Whether a value of a credential context looks like a secret: costly to guess, and not digits alone.

        What reads as prose costs nothing: in a value with digits words that stand apart and are listed or long, as in
        names of sections and versions; in one without digits whatever reads as a word, since no list has all languages.
        """
        if not any(c.isalpha() for c in value) and _kinds(value.rstrip(".,:;!?")) < 2:
            return False
        numbered = any(c.isdigit() for c in value)
        value = _unread(value, self._stands if numbered else _is_prose)
        return (self._remembered if len(value) <= REMEMBERED else self.costs_strong)(value)

    def _stands(self, piece: str, alone: bool) -> bool:
        return alone and ((len(piece) >= 4 and piece.lower() in self.rank) or _wordlike(piece))

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """Spans (kind, start, end) of a text by start, then kind."""
        found = []
        if ":" in text or "=" in text:
            low = text.lower()
            if "passw" in low or "secret" in low or "token" in low or "key" in low:
                found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]] if "AKIA" in text else []
        found += [("hex", m.start(), m.end()) for m in _RUNS.finditer(text)]
        covered = [(a, b) for _, a, b in found]
        if _WORDS_OF.search(text):
            for m in CONTEXT.finditer(text):
                k = 1 if m[1] is not None else 2
                a, b = m.span(k)
                b -= len(text[a:b]) - len(text[a:b].rstrip(".,:;!?)"))
                if b - a >= 6 and not any(x <= a and b <= y for x, y in covered) and self.is_strong(text[a:b]):
                    found.append(("guess", a, b))
        return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))

    def redacted(self, text: str) -> str:
        """The text with its secrets replaced by marks; of an assignment the value goes, its key stays."""
        out, at = [], 0
        for kind, a, b in self.scan(text):
            if kind == "assign":
                a += ASSIGN.match(text, a).start(2) - a
            if b <= at:
                continue
            out += [text[at : max(a, at)], f"[{kind}]" if a >= at else ""]
            at = b
        return "".join([*out, text[at:]])


def written(spans: list[tuple[str, int, int]]) -> str:
    """Spans as kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, words: str | None = None) -> DataFrame:
    """Counts of base matches, a digest of them, and all spans of every document; ``words`` is the path of a vocabulary.

    The driver reads the vocabulary (tens of thousands of words) and ships it with the plan.
    """
    listed = vocabulary(words) if words else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(listed)
        for whole in batches:
            for b in common.slices(whole, 1):
                all_spans = [guesser.scan(t or "") for t in b.column(1).to_pylist()]
                base = [[s for s in spans if s[0] != "guess"] for spans in all_spans]
                counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in LEAST]
                digests = pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, pa.array([written(s) for s in all_spans], pa.string())], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def clean(docs: DataFrame, words: str | None = None) -> DataFrame:
    """All documents, without the secrets in their texts; n_chars follows, other columns stay."""
    listed = vocabulary(words) if words else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(listed)
        for whole in batches:
            for b in common.slices(whole, "text"):
                at = b.schema.get_field_index("text")
                texts = [t if t is None else guesser.redacted(t) for t in b.column(at).to_pylist()]
                yield b.set_column(at, "text", pa.array(texts, pa.string()))

    changed = docs.mapInArrow(run, docs.schema)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else changed
