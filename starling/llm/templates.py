"""A small sandboxed template language, compiled to Python closures.

Text outside tags is copied. ``{{ expr }}`` prints, ``{% for x in expr %}``,
``{% if expr %}``/``elif``/``else``, ``{% set x = expr %}`` and
``{% generation %}`` are closed by ``endfor``, ``endif`` and ``endgeneration``.
What is printed inside ``generation`` is marked. Expressions know literals, names,
``a.key``/``a["key"]`` into dicts and lists, ``not and or``, comparisons, ``in``,
``+ - * // %``, ``~`` (joins as text), ``x if c else y`` and the filters of
``FILTERS``. There are no calls, no attributes of Python objects and no loops
but ``for`` over a given list, so a template cannot reach out of its values.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Emit = Callable[[dict, list], None]
MAX_TEXT = 1 << 20

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~<>|.,()\[\]=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}

FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(),
    "length": len, "string": str, "first": lambda x: x[0], "last": lambda x: x[-1],
}
_BINARY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "//": operator.floordiv, "%": operator.mod, "~": lambda a, b: f"{a}{b}",
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}
_LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%"))


class TemplateError(ValueError):
    """The template breaks the language, or asks for what it may not have."""


# ------------------------------------------------------------------ syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator or filter of plain values, evaluated in order."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """``and``, ``or`` and conditional expressions: only one branch is evaluated."""

    test: object
    then: object
    other: object
    keep: bool = False


@dataclass(frozen=True)
class Print:
    expr: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple
    other: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    expr: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---------------------------------------------------------------------- parsing


class _Expression:
    def __init__(self, source: str, filters: dict) -> None:
        self.tokens, at, self.filters = [], 0, filters
        source = source.rstrip()
        while at < len(source):
            match = _TOKENS.match(source, at)
            if not match:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            kind = match.lastindex
            self.tokens.append((("int", "str", "name", "op")[kind - 1], match[kind]))
            at = match.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1] in _WORDS:
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self, node):
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else Const("")
            return Choice(test, value, other)
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Choice(left, left, self.both(), keep=True)
        return left

    def both(self):
        left = self.negation()
        while self.take("and"):
            right = self.negation()
            left = Choice(Apply("not", (left,)), left, right)
        return left

    def negation(self):
        return Apply("not", (self.negation(),)) if self.take("not") else self.binary(0)

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.filtered()
        left = self.binary(level + 1)
        while True:
            op = next((o for o in _LEVELS[level] if " " not in o and self.peek(o)), None)
            if op is None and level == 0 and self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 1
                op = "not in"
            if op is None:
                return left
            self.at += 1
            left = Apply(op, (left, self.binary(level + 1)))

    def filtered(self):
        node = self.postfix()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = Apply(f"|{name}", (node,))
        return node

    def postfix(self):
        node = self.primary()
        while True:
            if self.take("."):
                node = Item(node, Const(self.name()))
            elif self.take("["):
                node = Item(node, self.choice())
                self.need("]")
            elif self.peek("("):
                raise TemplateError("there are no calls")
            else:
                return node

    def primary(self):
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.take("-"):
            return Apply("-", (Const(0), self.postfix()))
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, text = self.tokens[self.at]
        if kind == "int":
            self.at += 1
            return Const(int(text))
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name" and text in ("true", "false", "none"):
            self.at += 1
            return Const({"true": True, "false": False, "none": None}[text])
        return Name(self.name())


def parse(source: str, filters: dict | None = None) -> tuple:
    """The template's statements as a syntax tree."""
    known = FILTERS | (filters or {})
    pieces = iter([p for p in _TAGS.split(source) if p])

    def expression(text: str):
        e = _Expression(text, known)
        return e.end(e.choice())

    def block(closing: tuple[str, ...]) -> tuple[tuple, str, str]:
        out = []
        for piece in pieces:
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                out.append(Print(expression(piece[2:-2])))
                continue
            if not piece.startswith("{%"):
                out.append(Print(Const(piece)))
                continue
            word, _, rest = piece[2:-2].strip().partition(" ")
            if word in closing:
                return tuple(out), word, rest
            if word == "for":
                e = _Expression(rest, known)
                name = e.name()
                e.need("in")
                over = e.end(e.choice())
                out.append(Loop(name, over, block(("endfor",))[0]))
            elif word == "if":
                branches, other, test = [], (), rest
                while True:
                    body, end, more = block(("elif", "else", "endif"))
                    branches.append((expression(test), body))
                    test = more
                    if end == "else":
                        other = block(("endif",))[0]
                    if end != "elif":
                        break
                out.append(If(tuple(branches), other))
            elif word == "set":
                e = _Expression(rest, known)
                name = e.name()
                e.need("=")
                out.append(Assign(name, e.end(e.choice())))
            elif word == "generation":
                out.append(Generation(block(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if closing:
            raise TemplateError(f"missing {closing[-1]!r}")
        return tuple(out), "", ""

    return block(())[0]


# ------------------------------------------------------------- constant folding


def _apply(op: str, filters: dict) -> Callable:
    return operator.not_ if op == "not" else filters[op[1:]] if op[0] == "|" else _BINARY[op]


def fold(node, filters: dict | None = None):
    """The same tree with constant parts evaluated, and neighbouring texts joined."""
    known = FILTERS | (filters or {})

    def expr(n):
        if isinstance(n, Item):
            of, key = expr(n.of), expr(n.key)
            return Item(of, key)
        if isinstance(n, Apply):
            args = tuple(expr(a) for a in n.args)
            if all(isinstance(a, Const) for a in args) and n.op != "*":
                try:
                    return Const(_apply(n.op, known)(*(a.value for a in args)))
                except Exception:  # told when it is rendered, if ever
                    return Apply(n.op, args)
            return Apply(n.op, args)
        if isinstance(n, Choice):
            test = expr(n.test)
            if isinstance(test, Const):
                return expr(n.then if test.value else n.other)
            return Choice(test, expr(n.then), expr(n.other), n.keep)
        return n

    def body(statements: tuple) -> tuple:
        out: list = []
        for s in statements:
            if isinstance(s, Print):
                s = Print(expr(s.expr))
                if isinstance(s.expr, Const):
                    text = "" if s.expr.value is None else str(s.expr.value)
                    if out and isinstance(out[-1], Print) and isinstance(out[-1].expr, Const):
                        text = out.pop().expr.value + text
                    if text:
                        out.append(Print(Const(text)))
                    continue
            elif isinstance(s, Loop):
                s = Loop(s.name, expr(s.over), body(s.body))
            elif isinstance(s, Assign):
                s = Assign(s.name, expr(s.expr))
            elif isinstance(s, Generation):
                s = Generation(body(s.body))
            elif isinstance(s, If):
                branches, other, decided = [], body(s.other), False
                for test, inner in s.branches:
                    test = expr(test)
                    if isinstance(test, Const) and not test.value:
                        continue
                    if isinstance(test, Const):
                        other, decided = body(inner), True
                        break
                    branches.append((test, body(inner)))
                if not branches:
                    out.extend(other)
                    continue
                s = If(tuple(branches), other)
                del decided
            out.append(s)
        return tuple(out)

    return body(node)


# ----------------------------------------------------------------- code as closures


class _Mark:
    def __init__(self, name: str) -> None:
        self.name = name


BEGIN, END = _Mark("begin"), _Mark("end")


def _value(node, filters: dict) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name

        def lookup(scope: dict):
            if name not in scope:
                raise TemplateError(f"{name!r} is not defined")
            return scope[name]

        return lookup
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope: dict):
            container, at = of(scope), key(scope)
            if isinstance(container, dict):
                return container.get(at, "")
            if isinstance(container, list | tuple | str) and isinstance(at, int) and -len(container) <= at < len(container):
                return container[at]
            raise TemplateError(f"no item {at!r}")

        return item
    if isinstance(node, Choice):
        test, then, other = (_value(n, filters) for n in (node.test, node.then, node.other))
        if node.keep:

            def keep(scope: dict):
                value = test(scope)
                return value if value else other(scope)

            return keep
        return lambda scope: then(scope) if test(scope) else other(scope)
    args, fn = [_value(a, filters) for a in node.args], _apply(node.op, filters)

    def call(scope: dict):
        values = [a(scope) for a in args]
        if node.op == "*" and not all(isinstance(v, int) for v in values):
            raise TemplateError("only numbers are multiplied")
        try:
            return fn(*values)
        except TemplateError:
            raise
        except Exception as error:
            raise TemplateError(f"{node.op}: {error}") from error

    return call


def _statement(node, filters: dict) -> Callable[[dict], Iterator]:
    if isinstance(node, Print):
        value = _value(node.expr, filters)

        def emit(scope: dict) -> Iterator:
            out = value(scope)
            if out is not None and out != "":
                yield str(out)

        return emit
    if isinstance(node, Assign):
        name, value = node.name, _value(node.expr, filters)

        def assign(scope: dict) -> Iterator:
            scope[name] = value(scope)
            return iter(())

        return assign
    if isinstance(node, Loop):
        name, over, body = node.name, _value(node.over, filters), _body(node.body, filters)

        def loop(scope: dict) -> Iterator:
            items, outer = over(scope), (scope.get(name), scope.get("loop"))
            if isinstance(items, str | dict):
                raise TemplateError("for needs a list")
            items, index, done = iter(items), 0, object()
            current = next(items, done)
            while current is not done:
                following = next(items, done)
                scope[name] = current
                scope["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": following is done}
                yield from body(scope)
                current, index = following, index + 1
            scope[name], scope["loop"] = outer

        return loop
    if isinstance(node, Generation):
        body = _body(node.body, filters)

        def generation(scope: dict) -> Iterator:
            yield BEGIN
            yield from body(scope)
            yield END

        return generation
    branches = [(_value(t, filters), _body(b, filters)) for t, b in node.branches]
    other = _body(node.other, filters)

    def choose(scope: dict) -> Iterator:
        for test, body in branches:
            if test(scope):
                return body(scope)
        return other(scope)

    return choose


def _body(statements: tuple, filters: dict) -> Callable[[dict], Iterator]:
    steps = [_statement(s, filters) for s in statements]

    def run(scope: dict) -> Iterator:
        for step in steps:
            yield from step(scope)

    return run


class Template:
    """A compiled template; ``pieces`` renders piece by piece, so long lists need no more memory than one item."""

    def __init__(self, source: str, filters: dict | None = None) -> None:
        if len(source) > MAX_TEXT:
            raise TemplateError("template is too long")
        known = FILTERS | (filters or {})
        self._run = _body(fold(parse(source, filters), filters), known)

    def pieces(self, **values) -> Iterator[tuple[str, bool]]:
        """Texts, and whether they lie inside a generation."""
        inside = False
        for piece in self._run(dict(values)):
            if isinstance(piece, _Mark):
                inside = piece is BEGIN
            else:
                yield piece, inside

    def render(self, **values) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of its generations (none for empty ones)."""
        parts, spans, at, was = [], [], 0, False
        for text, inside in self.pieces(**values):
            if inside:
                if was and spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            parts.append(text)
            at, was = at + len(text), inside
        return "".join(parts), spans
