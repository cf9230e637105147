"""A small sandboxed template language for conversations, compiled to closures (used by operator 13).

    {% for message in messages %}{{ '<|user|>' ~ message.text | escape }}{% endfor %}

* ``{{ value }}``, ``{% if %} … {% elif %} … {% else %} … {% endif %}``, ``{% set name = value %}``, ``{# comment #}``; a minus inside a tag (``{%-``, ``-%}``) drops white space beside it.
* ``{% for name in messages %} … {% endfor %}`` once, at the top: turns are streamed, so memory holds one turn whatever the conversation's length. ``loop`` has ``first``, ``last``,
  ``index``, ``index0``, ``previtem`` and ``nextitem`` there.
* ``{% generation %} … {% endgeneration %}`` marks what a model is to learn.
* Values: strings, whole numbers, ``true``, ``false``, ``none``, names; ``value.key`` and ``value['key']`` for fields of a turn; ``* // %`` before ``+ -`` before ``~`` (joins texts), comparisons, ``in``, ``and or not``,
  ``a if b else c``, and the filters of ``FILTERS``.

There are no calls, no attributes of Python objects and no access to anything but the turns, so a template can neither reach the system nor run without end.
``compile_template`` parses to a syntax tree, folds what is constant (values, branches, neighbouring text) and turns the rest into nested Python functions.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template is not of this language, or asks a value for what it does not have."""


# ---- control strings ----------------------------------------------------------------------------------------------------


def escape(text: str) -> str:
    """No ``<|`` is left: one backslash more between ``<`` and ``|`` wherever only backslashes stand there."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def one_line(text: str) -> str:
    """No line end is left."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def from_one_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


# ---- syntax tree --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """A pure function of values: operators, comparisons and filters."""

    name: str
    parts: tuple


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be written")


def _number(f: Callable) -> Callable:
    def run(a, b):
        if not (isinstance(a, int) and isinstance(b, int)):
            raise TemplateError("arithmetic needs whole numbers")
        if f in (operator.floordiv, operator.mod) and b == 0:
            raise TemplateError("division by zero")
        return f(a, b)

    return run


def _plus(a, b):
    return a + b if isinstance(a, str) and isinstance(b, str) else _number(operator.add)(a, b)


def _ordered(f: Callable) -> Callable:
    def run(a, b):
        if not (isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int)):
            raise TemplateError("only two strings or two numbers have an order")
        return f(a, b)

    return run


def _within(a, b):
    if isinstance(b, str):
        return _text(a) in b
    if isinstance(b, dict):
        return a in b
    raise TemplateError("'in' needs a string or a turn")


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)), "line": lambda v: one_line(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, dict)) else len(_text(v)), "string": _text,
}
FUNCTIONS: dict[str, Callable] = {
    "~": lambda a, b: _text(a) + _text(b), "+": _plus, "-": _number(operator.sub), "*": _number(operator.mul), "//": _number(operator.floordiv), "%": _number(operator.mod),
    "==": operator.eq, "!=": operator.ne, "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt), ">=": _ordered(operator.ge),
    "in": _within, "not in": lambda a, b: not _within(a, b), "not": operator.not_, "neg": lambda a: _number(operator.sub)(0, a),
} | {f"|{name}": f for name, f in FILTERS.items()}


# ---- parser -------------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*%~<>|.()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"if", "else", "and", "or", "not", "in"}


class _Value:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r} in {self.source!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind in ("sign", "name") and value in wanted else None

    def take(self, *wanted: str) -> str | None:
        value = self.peek(*wanted)
        self.at += value is not None
        return value

    def need(self, *wanted: str) -> str:
        value = self.take(*wanted)
        if value is None:
            raise TemplateError(f"{' or '.join(wanted)} is missing in {self.source!r}")
        return value

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or value in _KEYWORDS:
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return value

    def end(self, value: object) -> object:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return value

    def value(self):
        yes = self.either()
        if not self.take("if"):
            return yes
        test = self.either()
        return Choice(test, yes, self.value() if self.take("else") else Const(None))

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Choice(left, left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Choice(left, self.negated(), left)
        return left

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while sign := self.take("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            if sign == "not":
                self.need("in")
                sign = "not in"
            left = Apply(sign, (left, self.joined()))
        return left

    def joined(self):
        left = self.sum()
        while self.take("~"):
            left = Apply("~", (left, self.sum()))
        return left

    def sum(self):
        left = self.product()
        while sign := self.take("+", "-"):
            left = Apply(sign, (left, self.product()))
        return left

    def product(self):
        left = self.signed()
        while sign := self.take("*", "//", "%"):
            left = Apply(sign, (left, self.signed()))
        return left

    def signed(self):
        return Apply("neg", (self.signed(),)) if self.take("-") else self.filtered()

    def filtered(self):
        value = self.atom()
        while sign := self.take(".", "[", "|"):
            if sign == ".":
                value = Get(value, Const(self.name()))
            elif sign == "[":
                value = Get(value, self.value())
                self.need("]")
            else:
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name!r}")
                value = Apply(f"|{name}", (value,))
        return value

    def atom(self):
        if self.take("("):
            value = self.value()
            self.need(")")
            return value
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind == "text":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Const(int(value))
        name = self.name()
        return Const(_WORDS[name]) if name in _WORDS else Name(name)


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """('text', …), ('value', …) and ('tag', …) in order; comments and trimmed white space are gone."""
    at, trim = 0, False
    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if any(sign in text for sign in ("{{", "{%", "{#")):
            raise TemplateError("a tag is not closed")
        body = m[0][2:-2] if m else ""
        comment = bool(m) and m[0].startswith("{#")
        if trim:
            text = text.lstrip()
        if not comment and body.startswith("-"):
            text, body = text.rstrip(), body[1:]
        trim = not comment and body.endswith("-")
        if text:
            yield "text", text
        if m and not comment:
            yield ("value" if m[0].startswith("{{") else "tag"), body.removesuffix("-").strip()
        at = m.end() if m else at


def parse(source: str) -> tuple:
    """The statements of a template."""
    pieces = list(_pieces(source))
    at = 0

    def block(ends: tuple[str, ...], top: bool = False) -> tuple[tuple, str]:
        nonlocal at
        found: list = []
        while at < len(pieces):
            kind, body = pieces[at]
            at += 1
            if kind == "text":
                found.append(Text(body))
                continue
            if kind == "value":
                v = _Value(body)
                found.append(Out(v.end(v.value())))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return tuple(found), body
            if word == "if":
                found.append(branch(rest))
            elif word == "set":
                v = _Value(rest)
                name = v.name()
                v.need("=")
                found.append(Set(name, v.end(v.value())))
            elif word == "generation" and not rest:
                found.append(Generation(block(("endgeneration",))[0]))
            elif word == "for":
                if not top:
                    raise TemplateError("turns are gone through at the top of a template only")
                v = _Value(rest)
                name = v.name()
                v.need("in")
                v.need("messages")
                v.end(None)
                found.append(For(name, block(("endfor",))[0]))
            else:
                raise TemplateError(f"unknown tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(found), ""

    def branch(test: str) -> If:
        v = _Value(test)
        value = v.end(v.value())
        yes, end = block(("elif", "else", "endif"))
        if end.startswith("elif"):
            return If(value, yes, (branch(end.partition(" ")[2]),))
        if end == "else":
            no, end = block(("endif",))
            return If(value, yes, no)
        return If(value, yes, ())

    tree = block((), top=True)[0]
    if sum(isinstance(s, For) for s in tree) > 1:
        raise TemplateError("turns are gone through once")
    return tree


# ---- folding ------------------------------------------------------------------------------------------------------------


def fold_value(v):
    """The value with everything constant worked out. What fails on constants stays, to fail where it is asked for."""
    if isinstance(v, Apply):
        parts = tuple(map(fold_value, v.parts))
        if all(isinstance(p, Const) for p in parts):
            try:
                return Const(FUNCTIONS[v.name](*(p.value for p in parts)))
            except TemplateError:
                pass
        if v.name == "~" and isinstance(parts[1], Const) and isinstance(parts[0], Apply) and parts[0].name == "~" and isinstance(parts[0].parts[1], Const):
            return Apply("~", (parts[0].parts[0], Const(_text(parts[0].parts[1].value) + _text(parts[1].value))))
        return Apply(v.name, parts)
    if isinstance(v, Choice):
        test = fold_value(v.test)
        if isinstance(test, Const):
            return fold_value(v.yes if test.value else v.no)
        return Choice(test, fold_value(v.yes), fold_value(v.no))
    if isinstance(v, Get):
        return Get(fold_value(v.of), fold_value(v.key))
    return v


def fold(statements: Iterable) -> tuple:
    out: list = []
    for s in statements:
        if isinstance(s, Out):
            value = fold_value(s.value)
            found: tuple = (Text(_text(value.value)),) if isinstance(value, Const) else (Out(value),)
        elif isinstance(s, Set):
            found = (Set(s.name, fold_value(s.value)),)
        elif isinstance(s, If):
            test = fold_value(s.test)
            found = fold(s.yes if test.value else s.no) if isinstance(test, Const) else (If(test, fold(s.yes), fold(s.no)),)
        elif isinstance(s, (Generation, For)):
            found = (Generation(fold(s.body)) if isinstance(s, Generation) else For(s.name, fold(s.body)),)
        else:
            found = (s,)
        for f in found:
            if isinstance(f, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + f.text)
            elif not isinstance(f, Text) or f.text:
                out.append(f)
    return tuple(out)


# ---- closures -----------------------------------------------------------------------------------------------------------

Emit = Callable[[str, bool], None]


def _value_closure(v) -> Callable[[dict], object]:
    if isinstance(v, Const):
        value = v.value
        return lambda env: value
    if isinstance(v, Name):
        name = v.name

        def look(env):
            if name not in env:
                raise TemplateError(f"{name!r} is not known here")
            return env[name]

        return look
    if isinstance(v, Get):
        of, key = _value_closure(v.of), _value_closure(v.key)

        def get(env):
            found, k = of(env), key(env)
            if not isinstance(found, dict):
                raise TemplateError("only turns and loop have fields")
            return found.get(k)

        return get
    if isinstance(v, Choice):
        test, yes, no = map(_value_closure, (v.test, v.yes, v.no))
        return lambda env: yes(env) if test(env) else no(env)
    f = FUNCTIONS[v.name]
    if len(v.parts) == 1:
        only = _value_closure(v.parts[0])
        return lambda env: f(only(env))
    left, right = map(_value_closure, v.parts)
    return lambda env: f(left(env), right(env))


def _closure(s) -> Callable[[dict, Emit, bool], None]:
    if isinstance(s, Text):
        text = s.text
        return lambda env, emit, learn: emit(text, learn)
    if isinstance(s, Out):
        value = _value_closure(s.value)
        return lambda env, emit, learn: emit(_text(value(env)), learn)
    if isinstance(s, Set):
        name, new = s.name, _value_closure(s.value)

        def put(env, emit, learn):
            env[name] = new(env)

        return put
    if isinstance(s, Generation):
        inner = _closures(s.body)
        return lambda env, emit, learn: inner(env, emit, True)
    test, yes, no = _value_closure(s.test), _closures(s.yes), _closures(s.no)
    return lambda env, emit, learn: yes(env, emit, learn) if test(env) else no(env, emit, learn)


def _closures(statements: Iterable) -> Callable[[dict, Emit, bool], None]:
    steps = [_closure(s) for s in statements]

    def run(env, emit, learn):
        for step in steps:
            step(env, emit, learn)

    return run


@dataclass
class Template:
    """``render`` streams turns (dicts of strings, numbers and None) to chunks: text and the (start, end) of its parts to be learnt; a chunk per turn, and one before and behind."""

    tree: tuple
    _parts: tuple = field(init=False)

    def __post_init__(self):
        k = next((i for i, s in enumerate(self.tree) if isinstance(s, For)), len(self.tree))
        loop = self.tree[k] if k < len(self.tree) else None
        self._parts = (_closures(self.tree[:k]), loop and (loop.name, _closures(loop.body)), _closures(self.tree[k + 1 :]))

    def render(self, turns: Iterable[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        head, loop, tail = self._parts
        texts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def emit(text: str, learn: bool) -> None:
            nonlocal at
            if not text:
                return
            if learn:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            texts.append(text)
            at += len(text)

        def chunk():
            nonlocal at
            out = "".join(texts), list(spans)
            texts.clear()
            spans.clear()
            at = 0
            return out

        env: dict = {}
        head(env, emit, False)
        if texts:
            yield chunk()
        if loop:
            name, body = loop
            before, now, index = None, None, 0
            for following in _with_end(turns):
                if now is not None:
                    inner = env | {name: now, "loop": {"first": index == 0, "last": following is None, "index": index + 1, "index0": index, "previtem": before, "nextitem": following}}
                    body(inner, emit, False)
                    yield chunk()
                    before, index = now, index + 1
                now = following
        tail(env, emit, False)
        if texts:
            yield chunk()


def _with_end(turns: Iterable[dict]) -> Iterator[dict | None]:
    yield from turns
    yield None


def compile_template(source: str) -> Template:
    return Template(fold(parse(source)))
