"""Chat formatting by a compiled, sandboxed template language.

    text  {{ expression }}  {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}  {% for x in e if e %} .. {% endfor %}
    {% for x, y in e %}  {% set x = e %}  {% set space.x = e %}  {% generation %} .. {% endgeneration %}  {# comment #}

A minus sign inside a tag's edge strips the white space beside it. With trim_blocks the line end behind a {% %} tag goes,
with lstrip_blocks the blanks before one that begins a line, as published chat templates expect.

Expressions know literals, lists, mappings, names, a.b, a['b'] and slices, + - * / // % ~, comparisons, in, and, or, not,
a if b else c, filters, `is` tests, a few methods of texts and mappings, range, namespace and raise_exception. There is no
way to Python's attributes or functions, so a template can reach nothing but its variables. Arithmetic takes numbers only
(+ also joins texts or lists); numbers, texts and lists that a template makes are bounded by LARGEST_NUMBER, LARGEST_TEXT
and LARGEST_RANGE, and what is folded at compile time by LARGEST_FOLDED. A name that a loop sets ends with its turn; a namespace outlives it.

A template is parsed into a syntax tree, constant parts are folded, and closures are made from what is left.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
INSIDE = rf"((?:{QUOTED}|[^'\"])*?)"
TAG = re.compile(rf"\{{\{{(-?){INSIDE}(-?)\}}\}}|\{{%(-?){INSIDE}(-?)%\}}|\{{#(-?).*?(-?)#\}}", re.S)
TOKEN = re.compile(rf"\s*(?:(\d+(?:\.\d+)?)|({QUOTED})|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*/%~<>()\[\]{{}}.|,:=]))", re.S)

#: What a template may make: the largest number, the longest text or list, the longest range, the largest folded value.
LARGEST_NUMBER, LARGEST_TEXT, LARGEST_RANGE, LARGEST_FOLDED = 1 << 63, 1 << 28, 100_000, 1 << 16

#: Strings that mark turns in the formatted text. None of them ends as another begins, so none can arise across a seam.
CONTROLS = ("[INST]", "[/INST]", "[ANS]", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]")
CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))

#: The default template: roles it knows by name have markers of their own, any other is written out.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}[ANS]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% else %}[ROLE]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/ROLE]{% endif %}"
    "{% endfor %}{% if add_generation_prompt %}[ANS]{% endif %}"
)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """text with a backslash before each backslash and each control string; unescape gives it back."""
    return CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _text(value: Any) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


def _bounded(value: Any) -> Any:
    """value, unless it is larger than a template may make."""
    if isinstance(value, (str, list)) and len(value) > LARGEST_TEXT or isinstance(value, int) and abs(value) > LARGEST_NUMBER:
        raise TemplateError("a value grows too large")
    return value


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _arithmetic(sign: str, call: Callable) -> Callable:
    def run(a: Any, b: Any) -> Any:
        if _number(a) and _number(b):
            if sign in ("/", "//", "%") and b == 0:
                raise TemplateError("division by zero")
            return _bounded(call(a, b))
        if sign == "+" and (isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list)):
            if len(a) + len(b) > LARGEST_TEXT:
                raise TemplateError("a value grows too large")
            return a + b
        raise TemplateError(f"{sign!r} can't take {type(a).__name__} and {type(b).__name__}")

    return run


def _joined(*parts: str) -> str:
    if sum(map(len, parts)) > LARGEST_TEXT:
        raise TemplateError("a value grows too large")
    return "".join(parts)


def _replace(text: str, old: str, new: str) -> str:
    if len(text) + (text.count(old) if old else len(text) + 1) * len(new) > LARGEST_TEXT:
        raise TemplateError("a value grows too large")
    return text.replace(old, new)


def _range(*bounds: int) -> list[int]:
    if not all(isinstance(b, int) for b in bounds) or len(made := range(*bounds)) > LARGEST_RANGE:
        raise TemplateError("range can't be that long")
    return list(made)


def _raise(message: Any = "") -> None:
    raise TemplateError(_text(message))


class Namespace(dict):
    """What namespace() makes: the only thing that a template can change."""


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "string": _text,
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "default": lambda v, other="": other if v is None else v,
    "join": lambda v, by="": _joined(*[x for k, y in enumerate(v or ()) for x in ([by] if k else []) + [_text(y)]]),
    "first": lambda v: v[0] if v else None,
    "last": lambda v: v[-1] if v else None,
    "list": lambda v: list(v or ()),
    "items": lambda v: [list(p) for p in v.items()] if isinstance(v, dict) else [],
    "replace": lambda v, old, new: _replace(_text(v), old, new),
    "int": lambda v: int(v) if _number(v) or isinstance(v, str) and re.fullmatch(r"\s*-?\d{1,18}\s*", v) else 0,
    "tojson": lambda v: json.dumps(v, ensure_ascii=False),
}

#: Methods by the type they belong to.
METHODS: dict[type, dict[str, Callable]] = {
    str: {
        "strip": lambda v, *c: v.strip(*c), "lstrip": lambda v, *c: v.lstrip(*c), "rstrip": lambda v, *c: v.rstrip(*c), "upper": str.upper, "lower": str.lower, "title": str.title,
        "startswith": lambda v, x: v.startswith(x), "endswith": lambda v, x: v.endswith(x), "split": lambda v, *by: v.split(*by), "replace": _replace,
    },
    dict: {"get": lambda v, k, other=None: v.get(k, other), "items": FILTERS["items"], "keys": lambda v: list(v), "values": lambda v: list(v.values())},
}

FUNCTIONS: dict[str, Callable] = {"namespace": lambda **v: Namespace(v), "range": _range, "raise_exception": _raise}

TESTS: dict[str, Callable] = {
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "mapping": lambda v: isinstance(v, dict),
    "sequence": lambda v: isinstance(v, (str, list)),
    "iterable": lambda v: isinstance(v, (str, list, dict)),
    "number": _number,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "true": lambda v: v is True,
    "false": lambda v: v is False,
    "odd": lambda v: v % 2 == 1,
    "even": lambda v: v % 2 == 0,
    "divisibleby": lambda v, by: v % by == 0,
    "equalto": operator.eq,
    "in": lambda v, among: v in (among or ()),
}

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": TESTS["in"]}
ARITHMETIC = {sign: _arithmetic(sign, call) for sign, call in (("+", operator.add), ("-", operator.sub), ("*", operator.mul), ("/", operator.truediv), ("//", operator.floordiv), ("%", operator.mod))}
ARITHMETIC["~"] = lambda a, b: _joined(_text(a), _text(b))


class _Expression:
    """A parser of one expression. Nodes are tuples: ('const', v), ('name', n), ('item', a, b), ('slice', a, from, to, step),
    ('list', items), ('dict', keys, values), ('filter'/'test', f, a, args), ('defined', a), ('method', name, a, args),
    ('call', f, args, names, values), ('op', f, a, b), ('and'/'or', a, b), ('not', a), ('if', condition, a, b)."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            kind = m.lastindex
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def parse(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much in {self.source!r}")
        return node

    def values(self) -> tuple[tuple, tuple]:
        """(what a loop runs over, the condition that its values have to meet)."""
        node = self.either()
        condition = self.either() if self.take("if") else ("const", True)
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much in {self.source!r}")
        return node, condition

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in (3, 4) and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing in {self.source!r}")

    def choice(self) -> tuple:
        node = self.either()
        if self.take("if"):
            condition = self.either()
            node = ("if", condition, node, self.choice() if self.take("else") else ("const", None))
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        node = self.sum()
        while sign := self.take(*COMPARE):
            node = ("op", COMPARE[sign], node, self.sum())
        if self.take("not"):
            self.need("in")
            node = ("not", ("op", COMPARE["in"], node, self.sum()))
        return node

    def sum(self) -> tuple:
        node = self.product()
        while sign := self.take("+", "-", "~"):
            node = ("op", ARITHMETIC[sign], node, self.product())
        return node

    def product(self) -> tuple:
        node = self.unary()
        while sign := self.take("*", "//", "/", "%"):
            node = ("op", ARITHMETIC[sign], node, self.unary())
        return node

    def unary(self) -> tuple:
        if sign := self.take("-", "+"):
            return ("op", ARITHMETIC[sign], ("const", 0), self.unary())
        return self.filtered()

    def word(self) -> str:
        """The name that stands next, taken."""
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != 3:
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def listed(self, end: str) -> tuple:
        """Expressions with commas between, up to `end`."""
        items = []
        while not self.take(end):
            items.append(self.choice())
            if not self.take(","):
                self.need(end)
                break
        return tuple(items)

    def filtered(self) -> tuple:
        node = self.item()
        while mark := self.take("|", "is"):
            if mark == "|":
                if (name := self.word()) not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", FILTERS[name], node, self.listed(")") if self.take("(") else ())
                continue
            negated = self.take("not")
            name = self.word().lower()
            if name in ("defined", "undefined"):
                made = ("defined", node) if name == "defined" else ("not", ("defined", node))
            elif name in TESTS:
                args = self.listed(")") if self.take("(") else (self.item(),) if name in ("in", "equalto", "divisibleby") else ()
                made = ("test", TESTS[name], node, args)
            else:
                raise TemplateError(f"no test {name!r}")
            node = ("not", made) if negated else made
        return node

    def item(self) -> tuple:
        node = self.atom()
        while mark := self.take(".", "[", "("):
            if mark == "[":
                node = self.subscript(node)
            elif mark == ".":
                name = self.word()
                if not self.take("("):
                    node = ("item", node, ("const", name))
                elif any(name in known for known in METHODS.values()):
                    node = ("method", name, node, self.listed(")"))
                else:
                    raise TemplateError(f"no method {name!r}")
            elif node[0] == "name" and node[1] in FUNCTIONS:
                node = self.call(FUNCTIONS[node[1]])
            else:
                raise TemplateError(f"there is nothing to call in {self.source!r}")
        return node

    def subscript(self, node: tuple) -> tuple:
        bounds, colons = [("const", None)] * 3, 0
        while not self.take("]"):
            if self.take(":"):
                colons += 1
                if colons > 2:
                    raise TemplateError(f"too many colons in {self.source!r}")
            else:
                bounds[colons] = self.choice()
                if self.at < len(self.tokens) and self.tokens[self.at][1] not in (":", "]"):
                    self.need("]")
        return ("slice", node, *bounds) if colons else ("item", node, bounds[0])

    def call(self, function: Callable) -> tuple:
        args, names, values = [], [], []
        while not self.take(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == 3 and self.tokens[self.at + 1] == (4, "="):
                names.append(self.word())
                self.need("=")
                values.append(self.choice())
            else:
                args.append(self.choice())
            if not self.take(","):
                self.need(")")
                break
        return ("call", function, tuple(args), ("const", names), tuple(values))

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError(f"something is missing in {self.source!r}")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            if len(text) > 18:
                raise TemplateError(f"{text!r} is too long a number")
            return ("const", float(text) if "." in text else int(text))
        if kind == 2:
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == 3:
            return ("const", {"true": True, "false": False, "none": None}[text.lower()]) if text.lower() in ("true", "false", "none") else ("name", text)
        if text == "(":
            node = self.choice()
            self.need(")")
            return node
        if text == "[":
            return ("list", self.listed("]"))
        if text == "{":
            keys, values = [], []
            while not self.take("}"):
                keys.append(self.choice())
                self.need(":")
                values.append(self.choice())
                if not self.take(","):
                    self.need("}")
                    break
            return ("dict", tuple(keys), tuple(values))
        raise TemplateError(f"{text!r} is out of place in {self.source!r}")


def parse(source: str, trim_blocks: bool = True, lstrip_blocks: bool = True) -> list[tuple]:
    """The syntax tree: ('text', s), ('out', e), ('if', [(e, body), ..]), ('for', names, e, condition, body), ('set', name, e),
    ('put', name, key, e), ('generation', body)."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, ""  # strip: what to take off the next text's beginning
    for m in [*TAG.finditer(source), None]:
        text = source[at : m.start() if m else None]
        line_begins = at == 0
        if strip == "-":
            text = text.lstrip()
        elif strip == "\n" and (end := re.match(r"\r?\n", text)):
            text, line_begins = text[end.end() :], True
        if m:
            before, tag = next(((m[k], m[k + 1]) for k in (1, 4) if m[k] is not None), (m[7], None))
            after, block = next((m[k] for k in (3, 6, 8) if m[k] is not None), ""), m[1] is None
            bare = text.rstrip(" \t")
            if before:
                text = text.rstrip()
            elif block and lstrip_blocks and (bare.endswith("\n") or not bare and line_begins):
                text = bare
            strip = "-" if after else "\n" if block and trim_blocks else ""
            at = m.end()
        if re.search(r"\{[{%#]", text):
            raise TemplateError(f"a tag doesn't end in {text[-40:]!r}")
        parts.append(("text", text))
        if m and tag is not None:
            parts.append(("out", tag) if m[1] is not None else ("tag", tag.strip()))
    body, k = _body(parts, 0, ())
    if k < len(parts):
        raise TemplateError(f"{parts[k][1]!r} closes nothing")
    return body


def _word(tag: str) -> tuple[str, str]:
    m = re.match(r"\w*", tag)
    return m[0], tag[m.end() :]


def _body(parts: list, k: int, until: tuple[str, ...]) -> tuple[list[tuple], int]:
    nodes: list[tuple] = []
    while k < len(parts):
        kind, text = parts[k]
        word, rest = _word(text) if kind == "tag" else ("", "")
        if kind == "tag" and word in until:
            return nodes, k
        k += 1
        if kind == "text":
            if text:
                nodes.append(("text", text))
        elif kind == "out":
            nodes.append(("out", _Expression(text).parse()))
        elif word == "if":
            arms, condition = [], _Expression(rest).parse()
            while True:
                inner, k = _body(parts, k, ("elif", "else", "endif"))
                arms.append((condition, inner))
                if k >= len(parts):
                    raise TemplateError("endif is missing")
                word, rest = _word(parts[k][1])
                k += 1
                if word == "endif":
                    break
                condition = _Expression(rest).parse() if word == "elif" else ("const", True)
            nodes.append(("if", arms))
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+in\s+(.*)", rest, re.S)
            inner, k = _body(parts, k, ("endfor",))
            if not m or k >= len(parts):
                raise TemplateError(f"for loop without an end or a name: {rest!r}")
            nodes.append(("for", re.split(r"\s*,\s*", m[1]), *_Expression(m[2]).values(), inner))
            k += 1
        elif word == "generation":
            inner, k = _body(parts, k, ("endgeneration",))
            if k >= len(parts):
                raise TemplateError("endgeneration is missing")
            nodes.append(("generation", inner))
            k += 1
        elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.S)):
            nodes.append(("set", m[1], _Expression(m[2]).parse()))
        elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.S)):
            nodes.append(("put", m[1], m[2], _Expression(m[3]).parse()))
        else:
            raise TemplateError(f"unknown tag {text!r}")
    return nodes, k


def fold_expression(node: tuple) -> tuple:
    """node with every part that no variable reaches replaced by its value; what fails stays, to fail when it is run."""
    if node[0] in ("const", "name", "defined"):
        return node
    inner = tuple(fold_expression(x) if isinstance(x, tuple) and x and isinstance(x[0], str) else tuple(map(fold_expression, x)) if isinstance(x, tuple) else x for x in node[1:])
    node = (node[0], *inner)
    if node[0] == "call":
        return node
    if node[0] == "if" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    flat = [y for x in inner for y in ([x] if isinstance(x, tuple) and x and isinstance(x[0], str) else x if isinstance(x, tuple) else [])]
    if all(x[0] == "const" for x in flat):
        try:
            value = _closure(node)({})
        except Exception:  # noqa: BLE001
            return node
        return node if isinstance(value, (str, list, dict)) and len(value) > LARGEST_FOLDED else ("const", value)
    return node


def fold(nodes: list[tuple]) -> list[tuple]:
    """The tree with constants folded: texts side by side joined, arms that can't be reached gone."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        if node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out" and (e := fold_expression(node[1]))[0] == "const":
            add(("text", _text(e[1])))
        elif node[0] == "out":
            add(("out", e))
        elif node[0] == "if":
            arms = []
            for condition, body in node[1]:
                condition = fold_expression(condition)
                if condition[0] != "const" or condition[1]:
                    arms.append((condition, fold(body)))
                if condition[0] == "const" and condition[1]:
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    add(inner)
            elif arms:
                add(("if", arms))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold_expression(node[3]), fold(node[4])))
        elif node[0] == "set":
            add(("set", node[1], fold_expression(node[2])))
        elif node[0] == "put":
            add(("put", node[1], node[2], fold_expression(node[3])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        else:
            add(node)
    return out


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int) and not isinstance(key, bool) and -len(value) <= key < len(value):
        return value[key]
    return None


def _has(value: Any, key: Any) -> bool:
    if isinstance(value, dict):
        return key in value
    return isinstance(value, (list, str)) and isinstance(key, int) and -len(value) <= key < len(value)


def _closure(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "item":
        a, b = map(_closure, node[1:])
        return lambda scope: _item(a(scope), b(scope))
    if kind == "slice":
        a, low, high, step = map(_closure, node[1:])

        def part(scope: dict) -> Any:
            value, bounds = a(scope), [low(scope), high(scope), step(scope)]
            if not isinstance(value, (str, list)) or bounds[2] == 0 or not all(b is None or isinstance(b, int) for b in bounds):
                raise TemplateError("a slice needs a text or a list, and whole numbers")
            return value[slice(*bounds)]

        return part
    if kind == "list":
        items = [_closure(x) for x in node[1]]
        return lambda scope: [x(scope) for x in items]
    if kind == "dict":
        keys, values = ([_closure(x) for x in xs] for xs in node[1:])
        return lambda scope: {k(scope): v(scope) for k, v in zip(keys, values, strict=True)}
    if kind == "defined":
        if node[1][0] == "name":
            name = node[1][1]
            return lambda scope: name in scope
        if node[1][0] == "item":
            a, b = map(_closure, node[1][1:])
            return lambda scope: _has(a(scope), b(scope))
        return lambda scope: True
    if kind == "method":
        name, a, args = node[1], _closure(node[2]), [_closure(x) for x in node[3]]

        def method(scope: dict) -> Any:
            value = a(scope)
            known = METHODS.get(dict if isinstance(value, dict) else type(value), {})
            if name not in known:
                raise TemplateError(f"{type(value).__name__} has no method {name!r}")
            return known[name](value, *(x(scope) for x in args))

        return method
    if kind == "call":
        call, args, names, values = node[1], [_closure(x) for x in node[2]], node[3][1], [_closure(x) for x in node[4]]
        return lambda scope: call(*(x(scope) for x in args), **{k: x(scope) for k, x in zip(names, values, strict=True)})
    if kind in ("filter", "test"):
        call, a, args = node[1], _closure(node[2]), [_closure(x) for x in node[3]]
        return (lambda scope: call(a(scope), *(x(scope) for x in args))) if args else (lambda scope: call(a(scope)))
    if kind == "op":
        call, a, b = node[1], _closure(node[2]), _closure(node[3])
        return lambda scope: call(a(scope), b(scope))
    if kind == "not":
        a = _closure(node[1])
        return lambda scope: not a(scope)
    if kind == "if":
        c, a, b = map(_closure, node[1:])
        return lambda scope: a(scope) if c(scope) else b(scope)
    a, b = _closure(node[1]), _closure(node[2])
    return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))


class _Output:
    __slots__ = ("parts", "length", "spans")

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)
        if self.length > LARGEST_TEXT:
            raise TemplateError("a text grows too large")


def _block(nodes: list[tuple]) -> Callable[[dict, _Output], None]:
    steps = [_statement(n) for n in nodes]

    def run(scope: dict, out: _Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _statement(node: tuple) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, out: out.add(text)
    if kind == "out":
        value = _closure(node[1])
        return lambda scope, out: out.add(_text(value(scope)))
    if kind == "set":
        name, value = node[1], _closure(node[2])
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "put":
        name, key, value = node[1], node[2], _closure(node[3])

        def put(scope: dict, out: _Output) -> None:
            if not isinstance(scope.get(name), Namespace):
                raise TemplateError(f"{name!r} is no namespace")
            scope[name][key] = value(scope)

        return put
    if kind == "if":
        arms = [(_closure(c), _block(b)) for c, b in node[1]]

        def choose(scope: dict, out: _Output) -> None:
            for condition, body in arms:
                if condition(scope):
                    return body(scope, out)

        return choose
    if kind == "generation":
        body = _block(node[1])

        def mark(scope: dict, out: _Output) -> None:
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))

        return mark
    names, values, condition, body = node[1], _closure(node[2]), None if node[3] == ("const", True) else _closure(node[3]), _block(node[4])

    def named(scope: dict, row: Any) -> dict:
        if len(names) > 1 and not (isinstance(row, list) and len(row) == len(names)):
            raise TemplateError(f"a loop's value has no {len(names)} parts")
        return scope | (dict(zip(names, row, strict=True)) if len(names) > 1 else {names[0]: row})

    def loop(scope: dict, out: _Output) -> None:
        rows = [r for r in values(scope) or [] if condition is None or condition(named(scope, r))]
        n = len(rows)
        for k, row in enumerate(rows):
            inner = named(scope, row)  # anew for each turn: what one sets doesn't reach the next
            inner["loop"] = {"index": k + 1, "index0": k, "revindex": n - k, "revindex0": n - k - 1, "first": k == 0, "last": k == n - 1, "length": n, "previtem": rows[k - 1] if k else None, "nextitem": rows[k + 1] if k + 1 < n else None}
            body(inner, out)

    return loop


class Template:
    """A compiled template. render gives the text and the spans (code points) of its generation blocks."""

    def __init__(self, source: str = TEMPLATE, trim_blocks: bool = True, lstrip_blocks: bool = True):
        self.made_from = source, trim_blocks, lstrip_blocks
        self.source, self.tree = source, fold(parse(*self.made_from))
        self.run = _block(self.tree)

    def __reduce__(self):
        return Template, self.made_from

    def render(self, messages: list[dict], **more: Any) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        self.run({"messages": messages, **more}, out)
        return "".join(out.parts), out.spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE made; raises ValueError for any other text."""
    pieces, at = [], 0
    for m in re.finditer(r"\\.|(" + CONTROL.pattern + ")", formatted, re.S):
        if m[1]:
            pieces += [unescape(formatted[at : m.start()]), m[1]]
            at = m.end()
    pieces.append(formatted[at:])
    known = {"[INST]": ("user", "[/INST]"), "[ANS]": ("assistant", "</s>"), "<<SYS>>": ("system", "<</SYS>>")}
    turns, k = [], 0
    while k + 3 < len(pieces):
        lead, start, text, stop = pieces[k : k + 4]
        if lead or start not in known and (start, stop) != ("[ROLE]", "[TEXT]"):
            raise ValueError("not a text of this template")
        if start in known:
            if stop != known[start][1]:
                raise ValueError("a turn ends otherwise than it began")
            turns.append((known[start][0], text))
            k += 4
        else:
            if pieces[k + 5 : k + 6] != ["[/ROLE]"]:
                raise ValueError("a turn with a role of its own doesn't end")
            turns.append((text, pieces[k + 4]))
            k += 6
    if k != len(pieces) - 1 or pieces[k]:
        raise ValueError("not a text of this template")
    return turns


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:int,stop:int>>"


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text): FORMATTED, with spans in code points.

    Turns stand by turn, equal ones by role and text; null roles and texts are empty; repeated rows are turns of their
    own; rows without a conv_id are one conversation.
    """
    made = Template(template)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [made.render(messages) for messages in batch.column("messages").to_pylist()]
            spans = [[{"start": a, "stop": b} for a, b in s] for _, s in out]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([t for t, _ in out], pa.string()), pa.array(spans, kind)], names=["conv_id", "formatted", "loss_spans"])

    return grouped.mapInArrow(run, FORMATTED)


PARSED = "conv_id long, formatted_chars long, turns array<struct<role:string,text:string>>, loss_text string"


def read_conversations(formatted: DataFrame) -> DataFrame:
    """PARSED, read back from FORMATTED rows: the turns, and all text under the loss mask, both without escapes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [[{"role": r, "text": x} for r, x in read_turns(t)] for t in texts]
            loss = ["".join(unescape(t[s["start"] : s["stop"]]) for s in spans) for t, spans in zip(texts, batch.column("loss_spans").to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(turns, kind), pa.array(loss, pa.string())], names=["conv_id", "formatted_chars", "turns", "loss_text"])

    return formatted.mapInArrow(run, PARSED)
