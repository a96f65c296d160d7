"""A compiler for a small, sandboxed template language.

    text                          copied
    {{ expr }}                    its value as text
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% endfor %}      loop.index0 and loop.first inside
    {% generation %} {% endgeneration %}   what the model is to learn
    {# comment #}

Expressions: names, ``a.b`` and ``a["b"]`` (keys of a mapping only), string,
integer and boolean literals, ``~`` (join as text), ``==`` ``!=`` ``and``
``or`` ``not``, parentheses, and filters ``e | name`` out of a given list.
There are no calls, no attributes and no imports: a template sees the mappings
it is given and nothing else.

``compile_template`` parses the source to a syntax tree, folds constants
(literals, joins, comparisons and filters of constants, branches that cannot
be taken, neighbouring texts) and turns each node into a Python closure.  A
closure yields (text, learned) pieces one by one, so a loop over an iterator
renders a conversation of any length in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """The source is not a template, or a template asks for what it may not have."""


# --- syntax tree -------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str  # "~", "==", "!=", "and", "or", "not"
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Show:
    expr: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) in order; the last may have Const(True)


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Learn:
    body: tuple


# --- parsing -----------------------------------------------------------------

_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[.\[\]()~|]))""", re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "true", "false"}


class _Expression:
    """Recursive descent, weakest first: or, and, not, comparison, join, filter, key, value."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *what: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != 2 and self.tokens[self.at][1] in what

    def take(self, *what: str) -> bool:
        found = self.peek(*what)
        self.at += found
        return found

    def need(self, what: str) -> None:
        if not self.take(what):
            raise TemplateError(f"{what!r} is missing")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
        if kind != 3 or text in _WORDS:
            raise TemplateError(f"a name is missing at {text!r}")
        self.at += 1
        return text

    def whole(self) -> Any:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Op("or", (node, self.both()))
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Op("and", (node, self.negated()))
        return node

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.joined()
        while self.peek("==", "!="):
            op = self.tokens[self.at][1]
            self.at += 1
            node = Op(op, (node, self.joined()))
        return node

    def joined(self) -> Any:
        node = self.filtered()
        while self.take("~"):
            node = Op("~", (node, self.filtered()))
        return node

    def filtered(self) -> Any:
        node = self.keyed()
        while self.take("|"):
            node = Filter(self.name(), node)
        return node

    def keyed(self) -> Any:
        node = self.value()
        while True:
            if self.take("."):
                node = Key(node, Const(self.name()))
            elif self.take("["):
                node = Key(node, self.either())
                self.need("]")
            else:
                return node

    def value(self) -> Any:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.take("true"):
            return Const(True)
        if self.take("false"):
            return Const(False)
        if self.at < len(self.tokens) and self.tokens[self.at][0] in (1, 2):
            kind, text = self.tokens[self.at]
            self.at += 1
            return Const(int(text) if kind == 1 else re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), text[1:-1], flags=re.S))
        return Name(self.name())


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    parts, at = [], 0
    for m in _PART.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("show", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()  # a stack: the next part last

    def body(*ends: str) -> tuple[tuple, str]:
        nodes = []
        while parts:
            kind, text = parts.pop()
            if kind == "text":
                nodes.append(Text(text))
            elif kind == "show":
                nodes.append(Show(_Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(nodes), text
                nodes.append(tag(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    def tag(word: str, rest: str) -> Any:
        if word == "if":
            branches, condition, end = [], _Expression(rest).whole(), ""
            while end != "endif":
                inner, end = body("elif", "else", "endif")
                branches.append((condition, inner))
                end, _, rest = end.partition(" ")
                if end == "elif":
                    condition = _Expression(rest).whole()
                elif end == "else":
                    inner, end = body("endif")
                    branches.append((Const(True), inner))
            return If(tuple(branches))
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not m or m[1] in _WORDS:
                raise TemplateError(f"cannot read 'for {rest}'")
            return For(m[1], _Expression(m[2]).whole(), body("endfor")[0])
        if word == "generation":
            return Learn(body("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return body()[0]


# --- constant folding --------------------------------------------------------


def _show(value: Any) -> str:
    return "" if value is None else str(value)


_OPS: dict[str, Callable] = {
    "~": lambda a, b: _show(a) + _show(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}


def fold_expr(node: Any, filters: Mapping[str, Callable[[str], str]]) -> Any:
    if isinstance(node, Key):
        return Key(fold_expr(node.of, filters), fold_expr(node.key, filters))
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        arg = fold_expr(node.arg, filters)
        return Const(filters[node.name](_show(arg.value))) if isinstance(arg, Const) else Filter(node.name, arg)
    if isinstance(node, Op):
        args = tuple(fold_expr(a, filters) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.op](*(a.value for a in args)))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Op(node.op, args)
    return node


def fold(nodes: tuple, filters: Mapping[str, Callable[[str], str]]) -> tuple:
    """Constants worked out, dead branches dropped, neighbouring texts joined."""
    out: list[Any] = []
    for node in nodes:
        if isinstance(node, Show):
            expr = fold_expr(node.expr, filters)
            found = (Text(_show(expr.value)),) if isinstance(expr, Const) else (Show(expr),)
        elif isinstance(node, If):
            branches = []
            for condition, inner in node.branches:
                condition = fold_expr(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, fold(inner, filters)))
                if isinstance(condition, Const):
                    break
            only = branches and isinstance(branches[0][0], Const)
            found = branches[0][1] if only else (If(tuple(branches)),) if branches else ()
        elif isinstance(node, For):
            found = (For(node.name, fold_expr(node.over, filters), fold(node.body, filters)),)
        elif isinstance(node, Learn):
            found = (Learn(fold(node.body, filters)),)
        else:
            found = (node,)
        for n in found:
            if isinstance(n, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + n.text)
            elif n != Text(""):
                out.append(n)
    return tuple(out)


# --- closures ----------------------------------------------------------------

Scope = dict[str, Any]
Piece = tuple[str, bool]


def _expr(node: Any, filters: Mapping[str, Callable[[str], str]]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        def name(scope, key=node.name):
            if key not in scope:
                raise TemplateError(f"unknown name {key!r}")
            return scope[key]
        return name
    if isinstance(node, Key):
        of, key = _expr(node.of, filters), _expr(node.key, filters)

        def item(scope):
            got = of(scope)
            if not isinstance(got, Mapping):
                raise TemplateError("only mappings have keys")
            return got.get(key(scope))
        return item
    if isinstance(node, Filter):
        arg, apply = _expr(node.arg, filters), filters[node.name]
        return lambda scope: apply(_show(arg(scope)))
    args = [_expr(a, filters) for a in node.args]
    if node.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    return lambda scope, op=_OPS[node.op]: op(*(a(scope) for a in args))


def _body(nodes: tuple, filters: Mapping[str, Callable[[str], str]], learned: bool) -> Callable[[Scope], Iterator[Piece]]:
    steps = [_node(n, filters, learned) for n in nodes]

    def run(scope: Scope) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)
    return run


def _node(node: Any, filters: Mapping[str, Callable[[str], str]], learned: bool) -> Callable[[Scope], Iterator[Piece]]:
    if isinstance(node, Text):
        piece = (node.text, learned)
        return lambda scope: (piece,)
    if isinstance(node, Show):
        value = _expr(node.expr, filters)
        return lambda scope: ((_show(value(scope)), learned),)
    if isinstance(node, Learn):
        return _body(node.body, filters, True)
    if isinstance(node, If):
        branches = [(_expr(c, filters), _body(b, filters, learned)) for c, b in node.branches]

        def choose(scope: Scope) -> Iterator[Piece]:
            for condition, inner in branches:
                if condition(scope):
                    return inner(scope)
            return iter(())
        return choose
    over, inner = _expr(node.over, filters), _body(node.body, filters, learned)

    def loop(scope: Scope) -> Iterator[Piece]:
        for k, x in enumerate(over(scope) or ()):
            yield from inner(scope | {node.name: x, "loop": {"index0": k, "first": k == 0}})
    return loop


def compile_template(source: str, filters: Mapping[str, Callable[[str], str]] | None = None) -> Callable[[Scope], Iterator[Piece]]:
    """A function from the given names to (text, learned) pieces in order."""
    filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower} | dict(filters or {})
    return _body(fold(parse(source), filters), filters, False)
