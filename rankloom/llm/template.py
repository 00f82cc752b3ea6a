"""A small sandboxed template language, compiled to Python closures.

Grammar: ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in list %} {% endfor %}``, ``{% set x = expression %}``,
``{% generation %} {% endgeneration %}`` (marks what a model is to write),
``{# comment #}``; a ``-`` inside a tag strips white space on that side.
Expressions: strings, integers, ``true false none``, names, ``a.key``,
``a[...]``, ``not and or``, comparisons, ``in``, ``+``, ``~`` (joins as text),
``x if c else y``, filters (``x | trim``) and ``raise_exception(text)``.

Sandbox: names are looked up in the values given, keys in mappings and lists
only; nothing else can be reached or called. Constant parts are folded when
the template is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    pass


# ---- syntax tree ----

@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.,()\[\]=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "~": lambda a, b: _text(a) + _text(b)}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
    "length": len, "string": lambda x: _text(x)}


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


_OPS["+"] = _add


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str, filters: dict):
        self.filters, self.tokens, p = filters, [], 0
        source = source.rstrip()
        while p < len(source):
            m = _TOKEN.match(source, p)
            if not m:
                raise TemplateError(f"cannot read {source[p:p + 20]!r}")
            s, n, name, op = m.groups()
            if s is not None:
                self.tokens.append(("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), s[1:-1], flags=re.S)))
            elif n is not None:
                self.tokens.append(("number", int(n)))
            else:
                self.tokens.append(("name", name) if name else ("op", op))
            p = m.end()
        self.at = 0

    def peek(self, kind: str, *values) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == kind and (not values or self.tokens[self.at][1] in values)

    def take(self, kind: str, *values):
        if not self.peek(kind, *values):
            raise TemplateError(f"expected {' or '.join(values) or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.either()
        if self.peek("name", "if"):
            self.at += 1
            test = self.either()
            self.take("name", "else")
            return Node("choice", None, [test, node, self.choice()])
        return node

    def _chain(self, word: str, below: Callable) -> Node:
        parts = [below()]
        while self.peek("name", word):
            self.at += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(word, None, parts)

    def either(self) -> Node:
        return self._chain("or", lambda: self._chain("and", self.negation))

    def negation(self) -> Node:
        if self.peek("name", "not"):
            self.at += 1
            return Node("not", None, [self.negation()])
        left = self.sum()
        if self.peek("op", "==", "!=", "<", ">", "<=", ">=") or self.peek("name", "in"):
            op = self.tokens[self.at][1]
            self.at += 1
            return Node("op", op, [left, self.sum()])
        if self.peek("name", "not"):
            self.at += 1
            self.take("name", "in")
            return Node("not", None, [Node("op", "in", [left, self.sum()])])
        return left

    def sum(self) -> Node:
        left = self.filtered()
        while self.peek("op", "+", "~"):
            op = self.take("op")
            left = Node("op", op, [left, self.filtered()])
        return left

    def filtered(self) -> Node:
        node = self.postfix()
        while self.peek("op", "|"):
            self.at += 1
            name = self.take("name")
            if name not in self.filters:
                raise TemplateError(f"no filter {name}")
            node = Node("filter", name, [node])
        return node

    def postfix(self) -> Node:
        node = self.atom()
        while self.peek("op", ".", "["):
            if self.take("op") == ".":
                node = Node("item", None, [node, Node("constant", self.take("name"))])
            else:
                node = Node("item", None, [node, self.choice()])
                self.take("op", "]")
        return node

    def atom(self) -> Node:
        if self.peek("op", "("):
            self.at += 1
            node = self.choice()
            self.take("op", ")")
            return node
        if self.peek("text") or self.peek("number"):
            self.at += 1
            return Node("constant", self.tokens[self.at - 1][1])
        name = self.take("name")
        if name.lower() in ("true", "false", "none"):
            return Node("constant", {"true": True, "false": False, "none": None}[name.lower()])
        if name == "raise_exception":
            self.take("op", "(")
            node = Node("raise", None, [self.choice()])
            self.take("op", ")")
            return node
        if name.startswith("_"):
            raise TemplateError(f"name {name} is not allowed")
        return Node("name", name)


def parse(source: str, filters: dict | None = None) -> Node:
    """The syntax tree of a template."""
    filters = FILTERS | (filters or {})
    items, p, strip = [], 0, False
    for m in _TAG.finditer(source):
        left, right = (m[1] or m[4] or m[7]), (m[3] or m[6] or m[8])
        text = source[p:m.start()]
        text = text.lstrip() if strip else text
        items.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            items.append(("print", m[2]))
        elif m[5] is not None:
            items.append(("tag", m[5].strip()))
        p, strip = m.end(), bool(right)
    items.append(("text", source[p:].lstrip() if strip else source[p:]))
    at = 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal at
        out = Node("block")
        while at < len(items):
            kind, value = items[at]
            at += 1
            if kind == "text":
                out.parts.append(Node("text", value))
            elif kind == "print":
                out.parts.append(Node("print", None, [_Expression(value, filters).whole()]))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return out, value
                out.parts.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    def statement(word: str, rest: str) -> Node:
        if word == "if":
            node = Node("if")
            test = _Expression(rest, filters).whole()
            while True:
                body, end = block("elif", "else", "endif")
                node.parts += [test, body]
                word, _, rest = end.partition(" ")
                if word == "endif":
                    return node
                if word == "else":
                    node.parts += [Node("constant", True), block("endif")[0]]
                    return node
                test = _Expression(rest, filters).whole()
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read for {rest}")
            return Node("for", m[1], [_Expression(m[2], filters).whole(), block("endfor")[0]])
        if word == "set":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read set {rest}")
            return Node("set", m[1], [_Expression(m[2], filters).whole()])
        if word == "generation":
            return Node("generation", None, [block("endgeneration")[0]])
        raise TemplateError(f"unknown tag {word}")

    return block()[0]


# ---- folding ----

def fold(node: Node, filters: dict | None = None) -> Node:
    """Evaluate constant parts, drop dead branches, join neighbouring texts."""
    filters = FILTERS | (filters or {})

    def constant(n: Node) -> bool:
        return n.kind == "constant"

    def go(n: Node) -> Node:
        parts = [go(p) for p in n.parts]
        n = Node(n.kind, n.value, parts)
        if n.kind == "op" and all(map(constant, parts)):
            return Node("constant", _OPS[n.value](parts[0].value, parts[1].value))
        if n.kind == "filter" and constant(parts[0]):
            return Node("constant", filters[n.value](parts[0].value))
        if n.kind == "not" and constant(parts[0]):
            return Node("constant", not parts[0].value)
        if n.kind == "choice" and constant(parts[0]):
            return parts[1] if parts[0].value else parts[2]
        if n.kind in ("and", "or"):
            out = []
            for i, p in enumerate(parts):
                if constant(p) and i < len(parts) - 1 and bool(p.value) == (n.kind == "and"):
                    continue        # cannot decide
                out.append(p)
                if constant(p) and bool(p.value) == (n.kind == "or"):
                    break           # decides
            return out[0] if len(out) == 1 else Node(n.kind, None, out)
        if n.kind == "print" and constant(parts[0]):
            return Node("text", _text(parts[0].value))
        if n.kind == "if":
            out = []
            for test, body in zip(parts[::2], parts[1::2]):
                if constant(test) and not test.value:
                    continue
                out += [test, body]
                if constant(test):
                    break
            if not out:
                return Node("text", "")
            return out[1] if constant(out[0]) else Node("if", None, out)
        if n.kind == "block":
            out = []
            for p in parts:
                for q in (p.parts if p.kind == "block" else [p]):
                    if q.kind == "text" and out and out[-1].kind == "text":
                        out[-1] = Node("text", out[-1].value + q.value)
                    elif q.kind != "text" or q.value:
                        out.append(q)
            return Node("block", None, out)
        return n
    return go(node)


# ---- closures ----

class Output:
    """Rendered text, and the spans that a model is to write."""

    def __init__(self):
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return None


def _expression(n: Node, filters: dict) -> Callable[[dict], object]:
    parts = [_expression(p, filters) for p in n.parts]
    if n.kind == "constant":
        value = n.value
        return lambda env: value
    if n.kind == "name":
        name = n.value
        return lambda env: env.get(name)
    if n.kind == "item":
        a, b = parts
        return lambda env: _item(a(env), b(env))
    if n.kind == "op":
        (a, b), f = parts, _OPS[n.value]
        return lambda env: f(a(env), b(env))
    if n.kind == "filter":
        a, f = parts[0], filters[n.value]
        return lambda env: f(a(env))
    if n.kind == "not":
        a = parts[0]
        return lambda env: not a(env)
    if n.kind == "choice":
        c, a, b = parts
        return lambda env: a(env) if c(env) else b(env)
    if n.kind == "raise":
        a = parts[0]

        def fail(env):
            raise TemplateError(_text(a(env)))
        return fail
    stop = n.kind == "or"

    def chain(env):
        value = None
        for p in parts:
            value = p(env)
            if bool(value) == stop:
                break
        return value
    return chain


def _statement(n: Node, filters: dict) -> Callable[[dict, Output], None]:
    if n.kind == "text":
        text = n.value
        return lambda env, out: out.write(text)
    if n.kind == "print":
        value = _expression(n.parts[0], filters)
        return lambda env, out: out.write(_text(value(env)))
    if n.kind == "set":
        name, value = n.value, _expression(n.parts[0], filters)

        def assign(env, out):
            env[name] = value(env)
        return assign
    if n.kind == "generation":
        body = _statement(n.parts[0], filters)

        def generate(env, out):
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))
        return generate
    if n.kind == "if":
        arms = [(_expression(t, filters), _statement(b, filters)) for t, b in zip(n.parts[::2], n.parts[1::2])]

        def branch(env, out):
            for test, body in arms:
                if test(env):
                    body(env, out)
                    return
        return branch
    if n.kind == "for":
        name, values, body = n.value, _expression(n.parts[0], filters), _statement(n.parts[1], filters)

        def loop(env, out):
            items = values(env) or []
            for i, x in enumerate(items):
                body(env | {name: x, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)
        return loop
    parts = [_statement(p, filters) for p in n.parts]

    def run(env, out):
        for p in parts:
            p(env, out)
    return run


def compile_template(source: str, filters: dict | None = None) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's values that returns the text and the
    spans written by ``generation`` blocks."""
    filters = FILTERS | (filters or {})
    body = _statement(fold(parse(source, filters), filters), filters)

    def render(**values):
        out = Output()
        body(dict(values), out)
        return "".join(out.pieces), out.spans
    return render
