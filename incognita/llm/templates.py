"""A small, sandboxed template language, compiled to Python closures.

    {{ expression }}                    the expression's text
    {% for x in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}    marks what is rendered inside as generated

Expressions: string and integer literals, ``true``, ``false``, ``none``, names, ``a.b`` (keys of mappings only, never
attributes of objects), ``a + b``, ``a ~ b`` (texts joined), ``== != < > <= >=``, ``and or not``, brackets, and filters
``a | name`` from a fixed table. There are no calls, subscripts, imports or attributes, so a template reaches nothing
but the values it is given. ``loop.index0``, ``loop.first`` and ``loop.last`` exist inside loops. A minus at a tag's edge
(``{%-``, ``-%}``) strips the white space beside it.

A template is lexed and parsed to a syntax tree; constant subtrees are folded, adjacent texts joined and branches with a
constant condition chosen; what is left becomes closures that write to a ``Sink``, which keeps the rendered text and the
spans of generation blocks.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """A template that can't be compiled, or a value that it can't render."""


# --- syntax tree --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body); the else branch has the condition Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


def as_text(value: Any) -> str:
    """A value as output; null is empty, and only plain values can be written."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} can't be written")


FILTERS: dict[str, Callable[[Any], Any]] = {
    "upper": lambda v: as_text(v).upper(),
    "lower": lambda v: as_text(v).lower(),
    "trim": lambda v: as_text(v).strip(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple)) else len(as_text(v)),
}
BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "+": operator.add,
    "~": lambda a, b: as_text(a) + as_text(b),
}

# --- lexing and parsing -------------------------------------------------------------------------------------------

_TAG = re.compile(r"(\{\{-?|\{%-?)(.*?)(-?\}\}|-?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 20]!r}")
        kind, at = m.lastgroup, m.end()
        v = m[kind]
        out.append((kind, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), v[1:-1], flags=re.S) if kind == "str" else int(v) if kind == "int" else v))
    return out


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, tokens: list[tuple[str, Any]], filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters = tokens, 0, filters

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str) -> Any:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self) -> Any:
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.joined()
        while op := self.take("==", "!=", "<", ">", "<=", ">="):
            node = Binary(op, node, self.joined())
        return node

    def joined(self) -> Any:
        node = self.filtered()
        while op := self.take("+", "~"):
            node = Binary(op, node, self.filtered())
        return node

    def filtered(self) -> Any:
        node = self.atom()
        while True:
            if self.take("."):
                node = Key(node, self.need("name"))
            elif self.take("|"):
                name = self.need("name")
                if name not in self.filters:
                    raise TemplateError(f"no filter {name}")
                node = Filter(node, name)
            else:
                return node

    def atom(self) -> Any:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("str", "int"):
            return Const(value)
        if kind == "name":
            return {"true": Const(True), "false": Const(False), "none": Const(None)}.get(value) or Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    """The template's syntax tree."""
    parts, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        parts += [("text", text.rstrip() if m[1].endswith("-") else text), ("out" if m[1].startswith("{{") else "tag", m[2])]
        at, strip = m.end(), m[3].startswith("-")
        if (m[1][1] == "{") != (m[3][-2] == "}"):
            raise TemplateError("a tag isn't closed as it was opened")
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    if any(kind == "text" and ("{{" in value or "{%" in value) for kind, value in parts):
        raise TemplateError("a tag isn't closed")
    nodes, end, rest = _block(parts, 0, filters, ())
    if rest < len(parts):
        raise TemplateError(f"unexpected {end}")
    return nodes


def _block(parts: list, at: int, filters: Mapping[str, Callable], ends: tuple[str, ...]) -> tuple[tuple, str, int]:
    """Nodes up to one of the end tags; that tag's words, and where the tag stands."""
    nodes: list = []
    while at < len(parts):
        kind, value = parts[at]
        if kind == "text":
            if value:
                nodes.append(Text(value))
        elif kind == "out":
            nodes.append(Output(_Expression(_tokens(value), filters).whole()))
        else:
            tokens = _tokens(value)
            word = tokens[0][1] if tokens else ""
            if word in ends:
                return tuple(nodes), value, at
            if word == "for":
                e = _Expression(tokens[1:], filters)
                name = e.need("name")
                if not e.take("in"):
                    raise TemplateError("for without in")
                over = e.whole()
                body, _, at = _block(parts, at + 1, filters, ("endfor",))
                nodes.append(For(name, over, body))
            elif word == "if":
                cases, condition, last = [], _Expression(tokens[1:], filters).whole(), False
                while True:
                    body, tag, at = _block(parts, at + 1, filters, ("endif",) if last else ("elif", "else", "endif"))
                    cases.append((condition, body))
                    words = _tokens(tag)
                    if words[0][1] == "endif":
                        break
                    last = words[0][1] == "else"
                    condition = Const(True) if last else _Expression(words[1:], filters).whole()
                nodes.append(If(tuple(cases)))
            elif word == "generation":
                body, _, at = _block(parts, at + 1, filters, ("endgeneration",))
                nodes.append(Generation(body))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), "", at


# --- folding ------------------------------------------------------------------------------------------------------


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The expression with its constant parts evaluated; what would fail is left to fail when rendered."""
    if isinstance(node, Binary):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if node.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (node.op == "and") else left
        node = Binary(node.op, left, right)
        if isinstance(left, Const) and isinstance(right, Const) and node.op in BINARY:
            try:
                return Const(BINARY[node.op](left.value, right.value))
            except (TypeError, TemplateError):
                return node
    elif isinstance(node, Not):
        of = fold(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    elif isinstance(node, Filter):
        of = fold(node.of, filters)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    elif isinstance(node, Key):
        return Key(fold(node.of, filters), node.key)
    return node


def fold_block(nodes: tuple, filters: Mapping[str, Callable]) -> tuple:
    """Constant outputs become text, adjacent texts one, and constant conditions their branch."""
    out: list = []
    for n in nodes:
        new: tuple = (n,)
        if isinstance(n, Output):
            of = fold(n.of, filters)
            new = (Text(as_text(of.value)),) if isinstance(of, Const) else (Output(of),)
        elif isinstance(n, For):
            new = (For(n.name, fold(n.over, filters), fold_block(n.body, filters)),)
        elif isinstance(n, Generation):
            new = (Generation(fold_block(n.body, filters)),)
        elif isinstance(n, If):
            cases = []
            for condition, body in n.cases:
                condition = fold(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, fold_block(body, filters)))
                if isinstance(condition, Const):
                    break
            sure = cases and isinstance(cases[0][0], Const)
            new = cases[0][1] if sure else (If(tuple(cases)),) if cases else ()
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return tuple(out)


# --- closures -----------------------------------------------------------------------------------------------------


class Sink:
    """Rendered text, and the spans (start, end) of generation blocks in code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def name(env: dict, n: str = node.name) -> Any:
            if n not in env:
                raise TemplateError(f"no value {n}")
            return env[n]

        return name
    if isinstance(node, Key):
        of = _value(node.of, filters)

        def key(env: dict, k: str = node.key) -> Any:
            value = of(env)
            if not isinstance(value, Mapping) or k not in value:
                raise TemplateError(f"no key {k}")
            return value[k]

        return key
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(of(env))
    if isinstance(node, Not):
        of = _value(node.of, filters)
        return lambda env: not of(env)
    left, right = _value(node.left, filters), _value(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)

    def binary(env: dict, op: Callable = BINARY[node.op]) -> Any:
        try:
            return op(left(env), right(env))
        except TypeError as e:
            raise TemplateError(str(e)) from e

    return binary


def _writer(nodes: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Sink], None]:
    steps: list[Callable[[dict, Sink], None]] = []
    for n in nodes:
        if isinstance(n, Text):
            steps.append(lambda env, out, t=n.text: out.write(t))
        elif isinstance(n, Output):
            steps.append(lambda env, out, v=_value(n.of, filters): out.write(as_text(v(env))))
        elif isinstance(n, Generation):

            def generation(env: dict, out: Sink, body: Callable = _writer(n.body, filters)) -> None:
                start = out.length
                body(env, out)
                out.spans.append((start, out.length))

            steps.append(generation)
        elif isinstance(n, If):

            def choice(env: dict, out: Sink, cases: list = [(_value(c, filters), _writer(b, filters)) for c, b in n.cases]) -> None:  # noqa: B006
                for condition, body in cases:
                    if condition(env):
                        body(env, out)
                        return

            steps.append(choice)
        else:

            def loop(env: dict, out: Sink, name: str = n.name, over: Callable = _value(n.over, filters), body: Callable = _writer(n.body, filters)) -> None:
                values = over(env)
                if not isinstance(values, (list, tuple)):
                    raise TemplateError("for needs a list")
                for k, v in enumerate(values):
                    body(env | {name: v, "loop": {"index0": k, "first": k == 0, "last": k == len(values) - 1}}, out)

            steps.append(loop)

    def run(env: dict, out: Sink) -> None:
        for s in steps:
            s(env, out)

    return run


class Template:
    """A compiled template; ``filters`` are added to the fixed ones."""

    def __init__(self, source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None):
        known = FILTERS | dict(filters or {})
        self.tree = fold_block(parse(source, known), known)
        self._run = _writer(self.tree, known)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans of its generation blocks."""
        out = Sink()
        self._run(values, out)
        return "".join(out.parts), out.spans
