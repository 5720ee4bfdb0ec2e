"""A compiler for a sandboxed template language: text to syntax tree, folded, to Python closures.

    {{ expression }}   {% set name = expression %}   {% if .. %} {% elif .. %} {% else %} {% endif %}
    {% for name in expression if test %} .. {% endfor %}   {% generation %} .. {% endgeneration %}   {# comment #}

A ``-`` inside a tag's bracket (``{{- -}} {%- -%} {#- -#}``) takes away the white space on that side. In a
loop there are loop.index, index0, first and last. Expressions have strings, numbers, true, false, none,
names, ``a.b`` and ``a['b']`` (keys of mappings and items of lists only), filters ``a|f``, ``a if b else c``,
``not and or``, comparisons, ``in``, ``is`` (not) defined, none, string, number, mapping or sequence,
``+ - * %`` and ``~`` (joins as text). Whatever else is written is an error, never silently text. There are no calls and no attributes of Python objects. A compiled template is a
function of a context that yields (text, generated) pieces; generated marks text inside generation
blocks. A loop takes any iterable, so a conversation of any length streams through.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any, NamedTuple


class TemplateError(ValueError):
    """What is wrong with a template or what it asks of its context."""


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Filtered(NamedTuple):
    of: Any
    name: str


class Choice(NamedTuple):
    test: Any
    yes: Any
    no: Any


class Is(NamedTuple):
    of: Any
    kind: str


class Unary(NamedTuple):
    op: str
    a: Any


class Binary(NamedTuple):
    op: str
    a: Any
    b: Any


class Text(NamedTuple):
    text: str


class Output(NamedTuple):
    value: Any


class Assign(NamedTuple):
    name: str
    value: Any


class If(NamedTuple):
    test: Any
    yes: list
    no: list


class For(NamedTuple):
    name: str
    items: Any
    test: Any  # items that fail it are left out; none: all are taken
    body: list


class Generation(NamedTuple):
    body: list


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


BINARY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod,
    "~": lambda a, b: _text(a) + _text(b), "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}


def _applied(f: Callable, *values: Any) -> Any:
    try:
        return f(*values)
    except (TypeError, ValueError, ZeroDivisionError, OverflowError) as e:
        raise TemplateError(str(e)) from None


LEVELS = [["or"], ["and"], ["==", "!=", "<", "<=", ">", ">=", "in", "not in"], ["+", "-", "~"], ["*", "%"]]
FILTERS: dict[str, Callable] = {"trim": lambda v: _text(v).strip(), "lower": lambda v: _text(v).lower(), "upper": lambda v: _text(v).upper(), "length": len, "text": _text}
_TOKEN = re.compile(r"""\s*(?:('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-<>+*%~|.()\[\]]))""", re.S)
_INSIDE = r"""((?:'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^'"])*?)"""
#: A comment, an output or a statement, each with what takes away white space before and after it.
_BLOCK = re.compile(r"\{#(-?).*?(-?)#\}|\{\{(-?)" + _INSIDE + r"(-?)\}\}|\{%(-?)" + _INSIDE + r"(-?)%\}", re.S)
_OPENS = re.compile(r"\{[{%#]")
_WORDS = frozenset("if else and or not in is".split())
KINDS: dict[str, Callable] = {
    "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "mapping": lambda v: isinstance(v, Mapping), "sequence": lambda v: isinstance(v, list | tuple | str),
}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: No constant is folded beyond this many characters.
MOST_FOLDED = 10_000


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"not understood: {source[at:at + 20]!r}")
            self.tokens.append(next((k, v) for k, v in enumerate(found.groups()) if v is not None))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] else None

    def take(self, wanted: str) -> bool:
        if self.peek() == wanted:
            self.at += 1
            return True
        return False

    def whole(self):
        value = self.choice()
        self.end()
        return value

    def choice(self):
        value = self.level(0)
        if self.take("if"):
            test = self.level(0)
            value = Choice(test, value, self.choice() if self.take("else") else Const(None))
        return value

    def end(self) -> None:
        if self.at != len(self.tokens):
            raise TemplateError(f"not expected: {self.tokens[self.at][1]!r}")

    def level(self, k: int):
        if k == len(LEVELS):
            return self.postfix()
        if k == 2 and self.take("not"):
            return Unary("not", self.level(2))
        left = self.level(k + 1)
        while True:
            op = self.peek()
            if op == "is" and k == 2:
                self.at += 1
                negated, (kind, name) = self.take("not"), self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
                if kind != 2 or name not in (*KINDS, "defined"):
                    raise TemplateError(f"nothing is {name!r}")
                self.at += 1
                left = Unary("not", Is(left, name)) if negated else Is(left, name)
                continue
            if op == "not" and k == 2 and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                op = "not in"
                self.at += 1
            if op not in LEVELS[k]:
                return left
            self.at += 1
            left = Binary(op, left, self.level(k + 1))

    def postfix(self):
        value = self.atom()
        while True:
            if self.take("."):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
                if kind != 2:
                    raise TemplateError("a name must follow the dot")
                self.at += 1
                value = Item(value, Const(name))
            elif self.take("["):
                value = Item(value, self.choice())
                if not self.take("]"):
                    raise TemplateError("] is missing")
            elif self.take("|"):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
                if kind != 2:
                    raise TemplateError("a filter's name must follow |")
                self.at += 1
                value = Filtered(value, name)
            else:
                return value

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == 0:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == 1:
            return Const(float(value) if "." in value else int(value))
        if kind == 2 and value in _WORDS:
            raise TemplateError(f"not expected: {value!r}")
        if kind == 2:
            return Const({"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else Name(value)
        if value == "(":
            inner = self.choice()
            if not self.take(")"):
                raise TemplateError(") is missing")
            return inner
        if value == "-":
            return Unary("-", self.postfix())
        raise TemplateError(f"not expected: {value!r}")


def parse(source: str) -> list:
    """The syntax tree of a template: a list of statements."""
    root: list = []
    stack: list[tuple[str, Any, list, list]] = []  # kind, head, body, where it goes
    body, at, trimmed = root, 0, False

    def literal(text: str, cut_after: bool) -> None:
        text = text.lstrip() if trimmed else text
        text = text.rstrip() if cut_after else text
        if opened := _OPENS.search(text):
            raise TemplateError(f"not closed: {text[opened.start():opened.start() + 20]!r}")
        if text:
            body.append(Text(text))

    for found in _BLOCK.finditer(source):
        literal(source[at : found.start()], bool(found[1] or found[3] or found[6]))
        at, trimmed = found.end(), bool(found[2] or found[5] or found[8])
        if found[4] is not None:
            body.append(Output(_Expression(found[4]).whole()))
            continue
        if found[7] is None:
            continue
        word, _, rest = found[7].strip().partition(" ")
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not name.strip().isidentifier():
                raise TemplateError(f"not understood: {found[0]!r}")
            body.append(Assign(name.strip(), _Expression(value).whole()))
        elif word in ("if", "for", "generation"):
            head: Any = None
            if word == "if":
                head = _Expression(rest).whole()
            elif word == "for":
                name, _, items = rest.partition(" in ")
                if not name.strip().isidentifier():
                    raise TemplateError(f"not understood: {found[0]!r}")
                own = _Expression(items)
                value = own.level(0)
                head = name.strip(), value, own.choice() if own.take("if") else None
                own.end()
            stack.append((word, head, [], body))
            body = stack[-1][2]
        elif word in ("elif", "else"):
            if not stack or stack[-1][0] != "if":
                raise TemplateError(f"{word} without if")
            kind, head, yes, out = stack.pop()
            no: list = []
            out.append(If(head, yes, no))
            if word == "elif":
                stack.append(("if", _Expression(rest).whole(), [], no))
            else:
                stack.append(("else", None, no, no))
            body = stack[-1][2]
        elif word in ("endif", "endfor", "endgeneration"):
            kind, head, inner, out = stack.pop() if stack else ("", None, [], root)
            if kind != ("if" if word == "endif" and kind != "else" else "else" if word == "endif" else word[3:]):
                raise TemplateError(f"{word} does not fit")
            if kind == "if":
                out.append(If(head, inner, []))
            elif kind == "for":
                out.append(For(*head, inner))
            elif kind == "generation":
                out.append(Generation(inner))
            body = root
            for _, _, open_body, _ in stack[-1:]:
                body = open_body
        else:
            raise TemplateError(f"not understood: {found[0]!r}")
    if stack:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    literal(source[at:], False)
    return root


def fold(tree: list, filters: Mapping[str, Callable] = FILTERS) -> list:
    """The tree with constant expressions worked out, constant branches chosen and neighbouring texts joined."""
    out: list = []
    for node in tree:
        for new in _folded(node, filters):
            if isinstance(new, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + new.text)
            elif not (isinstance(new, Text) and not new.text):
                out.append(new)
    return out


def _folded(node, filters) -> list:
    if isinstance(node, Output):
        value = _value(node.value, filters)
        return [Text(_text(value.value))] if isinstance(value, Const) else [Output(value)]
    if isinstance(node, Assign):
        return [Assign(node.name, _value(node.value, filters))]
    if isinstance(node, If):
        test = _value(node.test, filters)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no, filters)
        return [If(test, fold(node.yes, filters), fold(node.no, filters))]
    if isinstance(node, For):
        return [For(node.name, _value(node.items, filters), None if node.test is None else _value(node.test, filters), fold(node.body, filters))]
    if isinstance(node, Generation):
        return [Generation(fold(node.body, filters))]
    return [node]


def _value(e, filters):
    if isinstance(e, Unary):
        a = _value(e.a, filters)
        return Const(not a.value if e.op == "not" else -a.value) if isinstance(a, Const) else Unary(e.op, a)
    if isinstance(e, Binary):
        a, b = _value(e.a, filters), _value(e.b, filters)
        if isinstance(a, Const) and isinstance(b, Const):
            small = e.op != "*" or all(isinstance(x.value, int | float) for x in (a, b))
            if small and len(_text(a.value)) + len(_text(b.value)) <= MOST_FOLDED:
                return Const((a.value and b.value) if e.op == "and" else (a.value or b.value) if e.op == "or" else _applied(BINARY[e.op], a.value, b.value))
        return Binary(e.op, a, b)
    if isinstance(e, Filtered):
        of = _value(e.of, filters)
        if e.name not in filters:
            raise TemplateError(f"no filter {e.name}")
        return Const(_applied(filters[e.name], of.value)) if isinstance(of, Const) else Filtered(of, e.name)
    if isinstance(e, Item):
        return Item(_value(e.of, filters), _value(e.key, filters))
    if isinstance(e, Choice):
        test = _value(e.test, filters)
        yes, no = _value(e.yes, filters), _value(e.no, filters)
        return (yes if test.value else no) if isinstance(test, Const) else Choice(test, yes, no)
    if isinstance(e, Is):
        of = _value(e.of, filters)
        return Const(e.kind == "defined" or KINDS[e.kind](of.value)) if isinstance(of, Const) else Is(of, e.kind)
    return e


class _Loop(dict):
    """What a loop says of itself."""


def _defined(e, filters) -> Callable[[dict], bool]:
    """Whether a name has a value, or a mapping a key, or a list an item."""
    if isinstance(e, Name):
        return lambda ctx, n=e.name: n in ctx
    if isinstance(e, Item):
        whole, of, key = _defined(e.of, filters), _closure(e.of, filters), _closure(e.key, filters)

        def has(ctx):
            if not whole(ctx):
                return False
            value, k = of(ctx), key(ctx)
            return k in value if isinstance(value, Mapping) else isinstance(value, list | tuple | str) and isinstance(k, int) and -len(value) <= k < len(value)

        return has
    return lambda ctx: True


def _looked_ahead(items) -> Iterator[tuple[Any, bool]]:
    """Each item and whether it is the last one; one item is held."""
    it = iter(items)
    for held in it:
        for value in it:
            yield held, False
            held = value
        yield held, True


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _closure(e, filters) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda ctx, v=e.value: v
    if isinstance(e, Name):
        def named(ctx, n=e.name):
            if n not in ctx:
                raise TemplateError(f"no value {n}")
            return ctx[n]

        return named
    if isinstance(e, Item):
        of, key = _closure(e.of, filters), _closure(e.key, filters)

        def item(ctx):
            value, k = of(ctx), key(ctx)
            if isinstance(value, _Loop) and k not in value:
                raise TemplateError(f"a loop has no {k!r}")
            if isinstance(value, Mapping):
                return value.get(k)
            if isinstance(value, list | tuple | str) and isinstance(k, int) and -len(value) <= k < len(value):
                return value[k]
            raise TemplateError(f"no item {k!r}")

        return item
    if isinstance(e, Filtered):
        return lambda ctx, f=filters[e.name], of=_closure(e.of, filters): _applied(f, of(ctx))
    if isinstance(e, Choice):
        return lambda ctx, t=_closure(e.test, filters), y=_closure(e.yes, filters), n=_closure(e.no, filters): y(ctx) if t(ctx) else n(ctx)
    if isinstance(e, Is):
        return _defined(e.of, filters) if e.kind == "defined" else lambda ctx, f=KINDS[e.kind], of=_closure(e.of, filters): f(of(ctx))
    if isinstance(e, Unary):
        a = _closure(e.a, filters)
        return (lambda ctx: not a(ctx)) if e.op == "not" else (lambda ctx: -a(ctx))
    a, b = _closure(e.a, filters), _closure(e.b, filters)
    if e.op == "and":
        return lambda ctx: a(ctx) and b(ctx)
    if e.op == "or":
        return lambda ctx: a(ctx) or b(ctx)
    if e.op == "*":
        def times(ctx):
            x, y = a(ctx), b(ctx)
            if not all(isinstance(v, int | float) for v in (x, y)):
                raise TemplateError("only numbers can be multiplied")
            return x * y

        return times
    return lambda ctx, f=BINARY[e.op]: _applied(f, a(ctx), b(ctx))


def _statement(node, filters) -> Render:
    if isinstance(node, Text):
        def text(ctx, generated, t=node.text):
            yield t, generated

        return text
    if isinstance(node, Output):
        def output(ctx, generated, value=_closure(node.value, filters)):
            yield _text(value(ctx)), generated

        return output
    if isinstance(node, Assign):
        def assign(ctx, generated, n=node.name, value=_closure(node.value, filters)):
            ctx[n] = value(ctx)
            yield from ()

        return assign
    if isinstance(node, If):
        def choose(ctx, generated, test=_closure(node.test, filters), yes=_statements(node.yes, filters), no=_statements(node.no, filters)):
            return (yes if test(ctx) else no)(ctx, generated)

        return choose
    if isinstance(node, For):
        test = None if node.test is None else _closure(node.test, filters)

        def loop(ctx, generated, n=node.name, items=_closure(node.items, filters), body=_statements(node.body, filters)):
            found = items(ctx)
            if not hasattr(found, "__iter__"):
                raise TemplateError(f"{n} has nothing to go through")
            taken = found if test is None else (v for v in found if test(ctx | {n: v}))
            for k, (value, last) in enumerate(_looked_ahead(taken)):
                yield from body(ctx | {n: value, "loop": _Loop(index=k + 1, index0=k, first=k == 0, last=last)}, generated)

        return loop

    inner = _statements(node.body, filters)
    return lambda ctx, generated: inner(ctx, True)


def _statements(tree: list, filters) -> Render:
    all_ = [_statement(n, filters) for n in tree]

    def run(ctx, generated):
        for one in all_:
            yield from one(ctx, generated)

    return run


def compiled(source: str, more_filters: Mapping[str, Callable] | None = None) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """The template as a function from a context to its pieces of text, each with its generation mark."""
    filters = {**FILTERS, **(more_filters or {})}
    run = _statements(fold(parse(source), filters), filters)
    return lambda ctx: run(dict(ctx), False)
