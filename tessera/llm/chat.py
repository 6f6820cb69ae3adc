"""Chat formatting by a template compiler.

A template (``{{ expression }}``, ``{% for %}``, ``{% if %}``, ``{% set %}``,
``{% generation %}``, ``{# comment #}``, ``-`` for blanks to drop) is parsed into a
syntax tree, constants are folded, and the tree becomes Python closures that write
text; what stands in a generation block is marked for the loss. The language is a
sandbox: names, keys of mappings, items of lists, literals, operators and the filters
of FILTERS; there are no calls but of ``raise_exception``, no attributes of objects,
no import. Messages are read as they come.

Texts cannot forge a turn: all control strings begin with < or [, and the filter
``escape`` writes a backslash after each of these and doubles each backslash, which
``unescape`` takes back. ``escape_role`` also writes a line end as backslash and n.

Conversations are sorted by the shuffle and read in order, one at a time; a task holds
the text of one conversation, which is one value of its result.

Defined results: rows of a conversation are ordered by turn (null first), then role
and text, so repeated rows repeat; a null role or text is empty; null conv_ids are one
conversation; an empty table gives an empty result; other columns are not looked at."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

TEMPLATE = """{%- for message in messages -%}
<|im_start|>{{ message.role | escape_role }}
{% if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif %}<|im_end|>
{% endfor -%}"""
START, END = "<|im_start|>", "<|im_end|>\n"


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([\\<\[])\\", r"\1", text)


def escape_role(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape_role(text: str) -> str:
    return re.sub(r"([\\<\[])\\|\\n", lambda m: m[1] or "\n", text)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}

# --- lexer and parser: nodes are tuples (kind, ...) --------------------------------------------------------------

_PIECE = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>()\[\].,|=:]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        at = m.end()
        if m[1]:
            out.append(("value", float(m[1]) if "." in m[1] else int(m[1])))
        elif m[2]:
            out.append(("value", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), m[2][1:-1], flags=re.S)))
        elif m[3]:
            out.append(("value", _WORDS[m[3]]) if m[3] in _WORDS else ("name", m[3]))
        else:
            out.append(("op", m[4]))
    return out


class _Expression:
    """Recursive descent over: ternary, or, and, not, comparison, sum, product, unary, filters and items."""

    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "value" and self.tokens[self.at][1] in values

    def take(self, *values: str):
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str):
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self):
        node = self.ternary()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def ternary(self):
        node = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            other = self.ternary() if self.take("else") else ("const", "")
            return ("choose", test, node, other)
        return node

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in", "not"), ("+", "-", "~"), ("*", "%"))

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.unary()
        if level == 2:
            return ("not", self.binary(2)) if self.take("not") else self.binary(3)
        node = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            if op == "not":
                self.need("in")
                node = ("not", ("binary", "in", node, self.binary(level + 1)))
            else:
                node = ("binary", op, node, self.binary(level + 1))
        return node

    def unary(self):
        if self.take("-"):
            return ("binary", "-", ("const", 0), self.unary())
        node = self.primary()
        while True:
            if self.take("."):
                node = ("item", node, ("const", self.name()))
            elif self.take("["):
                node = ("item", node, self.ternary())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", name, node)
            else:
                return node

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def primary(self):
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "value":
            self.at += 1
            return ("const", self.tokens[self.at - 1][1])
        if self.take("("):
            node = self.ternary()
            self.need(")")
            return node
        name = self.name()
        if self.take("("):
            if name != "raise_exception":
                raise TemplateError(f"{name} can't be called")
            node = ("raise", self.ternary())
            self.need(")")
            return node
        return ("name", name)


def parse(source: str):
    """The syntax tree of a template."""
    pieces, at, strip = [], 0, False
    for m in _PIECE.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1].endswith("-") else text
        if text:
            pieces.append(("text", text))
        kind = m[1][:2]
        if {"{{": "}}", "{%": "%}", "{#": "#}"}[kind] != m[3][-2:]:
            raise TemplateError(f"{m[0]!r} isn't closed")
        if kind != "{#":
            pieces.append((kind, m[2]))
        strip, at = m[3].startswith("-"), m.end()
    tail = source[at:].lstrip() if strip else source[at:]
    if re.search(r"\{\{|\{%|\{#", tail):
        raise TemplateError("a tag isn't closed")
    if tail:
        pieces.append(("text", tail))
    body, end, rest = _block(pieces, 0, ())
    return body


def _block(pieces, at, ends):
    """Nodes up to a tag of ends, that tag's expression parser, and where it goes on."""
    out = []
    while at < len(pieces):
        kind, text = pieces[at]
        at += 1
        if kind == "text":
            out.append(("write", ("const", text)))
        elif kind == "{{":
            out.append(("write", _Expression(_tokens(text)).whole()))
        else:
            e = _Expression(_tokens(text))
            word = e.name()
            if word in ends:
                return ("block", out), (word, e), at
            if word == "for":
                name = e.name()
                e.need("in")
                what = e.whole()
                body, _, at = _block(pieces, at, ("endfor",))
                out.append(("for", name, what, body))
            elif word == "if":
                arms, other, test = [], ("block", []), e.whole()
                while True:
                    body, (end, more), at = _block(pieces, at, ("elif", "else", "endif"))
                    arms.append((test, body))
                    if end == "elif":
                        test = more.whole()
                        continue
                    if end == "else":
                        other, _, at = _block(pieces, at, ("endif",))
                    break
                node = other
                for test, body in reversed(arms):
                    node = ("if", test, body, node)
                out.append(node)
            elif word == "set":
                name = e.name()
                e.need("=")
                out.append(("set", name, e.whole()))
            elif word == "generation":
                body, _, at = _block(pieces, at, ("endgeneration",))
                out.append(("generation", body))
            else:
                raise TemplateError(f"no tag {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return ("block", out), None, at


# --- constant folding ------------------------------------------------------------------------------------------

_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b, "~": lambda a, b: _text(a) + _text(b),
}


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def fold(node):
    """The tree with constant expressions evaluated, constant branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        out = []
        for child in map(fold, node[1]):
            for c in child[1] if child[0] == "block" else [child]:
                if c[0] == "write" and c[1][0] == "const" and out and out[-1][0] == "write" and out[-1][1][0] == "const":
                    out[-1] = ("write", ("const", _text(out[-1][1][1]) + _text(c[1][1])))
                else:
                    out.append(c)
        return ("block", out)
    node = (kind, *(fold(x) if isinstance(x, tuple) else x for x in node[1:]))
    if kind in ("if", "choose") and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    if kind == "binary" and node[1] in ("and", "or") and node[2][0] == "const":
        return node[3] if bool(node[2][1]) == (node[1] == "and") else node[2]
    if kind in ("binary", "not", "filter", "item") and all(x[0] == "const" for x in node[1:] if isinstance(x, tuple)):
        return ("const", _value(node)({}))
    return node


# --- closures --------------------------------------------------------------------------------------------------


def _item(a, b):
    if isinstance(a, dict):
        return a.get(b)
    if isinstance(a, (list, tuple)) and isinstance(b, int):
        return a[b] if -len(a) <= b < len(a) else None
    raise TemplateError(f"no items in {type(a).__name__}")


def _value(node) -> Callable:
    """The closure that gives an expression's value in an environment."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "item":
        a, b = _value(node[1]), _value(node[2])
        return lambda env: _item(a(env), b(env))
    if kind == "filter":
        f, a = FILTERS[node[1]], _value(node[2])
        return (lambda env: f(a(env))) if node[1] == "length" else lambda env: f(_text(a(env)))
    if kind == "not":
        a = _value(node[1])
        return lambda env: not a(env)
    if kind == "choose":
        test, a, b = map(_value, node[1:])
        return lambda env: a(env) if test(env) else b(env)
    if kind == "raise":
        a = _value(node[1])

        def fail(env):
            raise TemplateError(_text(a(env)))

        return fail
    a, b = _value(node[2]), _value(node[3])
    if node[1] == "and":
        return lambda env: a(env) and b(env)
    if node[1] == "or":
        return lambda env: a(env) or b(env)
    op = _OPERATORS[node[1]]
    return lambda env: op(a(env), b(env))


class Output:
    """Text as it is written, and the spans of it that are under the loss mask."""

    def __init__(self):
        self.parts, self.at, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def _writer(node) -> Callable:
    """The closure that writes a node in an environment to an output."""
    kind = node[0]
    if kind == "write":
        if node[1][0] == "const":
            text = _text(node[1][1])
            return lambda env, out: out.write(text)
        value = _value(node[1])
        return lambda env, out: out.write(_text(value(env)))
    if kind == "block":
        steps = [_writer(x) for x in node[1]]
        if len(steps) == 1:
            return steps[0]

        def block(env, out):
            for step in steps:
                step(env, out)

        return block
    if kind == "if":
        test, yes, no = _value(node[1]), _writer(node[2]), _writer(node[3])
        return lambda env, out: (yes if test(env) else no)(env, out)
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(env, out):
            env[name] = value(env)

        return assign
    if kind == "generation":
        inner = _writer(node[1])

        def generation(env, out):
            start = out.at
            inner(env, out)
            out.spans.append((start, out.at))

        return generation
    if kind == "for":
        name, what, body = node[1], _value(node[2]), _writer(node[3])

        def loop(env, out):
            own, items, i = dict(env), iter(what(env) or ()), 0
            ahead = next(items, _writer)
            while ahead is not _writer:
                item, ahead = ahead, next(items, _writer)
                own[name], own["loop"] = item, {"index": i + 1, "index0": i, "first": i == 0, "last": ahead is _writer}
                body(own, out)
                i += 1

        return loop
    value = _value(node)  # raise_exception
    return lambda env, out: value(env)


class Template:
    """A compiled template; render(messages, **more) gives the text and the spans under the loss mask."""

    def __init__(self, source: str = TEMPLATE):
        self.tree = fold(parse(source))
        self._write = _writer(self.tree)

    def render(self, messages, **more) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self._write({"messages": messages, **more}, out)
        return "".join(out.parts), out.spans


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a conversation formatted by TEMPLATE."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans (start, end: what is under the loss mask, in code points)."""
    tune(conversations.sparkSession)
    Template(template)  # errors show here
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]):
        compiled = Template(template)
        turns = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        done = []
        held = 0
        for conv, own in itertools.groupby(turns, key=lambda r: r[0]):
            formatted, spans = compiled.render({"role": r, "text": t} for _, r, t in own)
            done.append({"conv_id": conv, "formatted": formatted, "spans": [{"start": a, "end": b} for a, b in spans]})
            held += len(formatted)
            if held > 1 << 22:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done, held = [], 0
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return rows.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    tune(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                turns, n = hashlib.sha256(), 0
                for role, text in read_back(row["formatted"]):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                loss = [unescape(row["formatted"][s["start"] : s["end"]]) for s in row["spans"]]
                rows.append((row["conv_id"], n, turns.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(row["formatted"])))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
