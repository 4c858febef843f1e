"""Chat formatting with a small sandboxed template language, compiled to Python closures.

A template is parsed into a syntax tree, constant parts of the tree are folded, and the tree becomes nested closures
that are run once for each conversation. The language has literal text, ``{{ expression }}``, ``{% for x in y %}``
with ``loop.index0/first/last``, ``{% if %}/{% elif %}/{% else %}``, ``{% set x = expression %}``,
``{% generation %}...{% endgeneration %}`` and ``{# comment #}``; a hyphen inside a tag strips white space on that
side. Expressions have string, integer and boolean literals, ``+ ~ == != and or not in``, ``x.key``, ``x['key']``,
parentheses and the filters ``upper lower trim length escape oneline``. Nothing else can be reached: a template has no
attribute access on Python objects and no calls.

What a template writes goes through the output as pieces with a loss flag: text written inside a generation block is
under the loss mask. ``escape`` makes control strings inside a text harmless and can be undone: every ``<|`` becomes
``<\\u200b|`` after any run of U+200B that already stands in that place got one more of it.

Defined results: null text and null role are empty strings; turns are taken in the order (turn, role, text), nulls
first; repeated rows stay; rows with a null conv_id are one conversation of id null; no rows give no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = """{%- for m in messages -%}
{{ '<|im_start|>' ~ (m.role | escape | oneline) ~ '\\n' }}
{%- if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
{{ '<|im_end|>' + '\\n' }}
{%- endfor -%}"""
GUARD = "\u200b"


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


def escape(text: str) -> str:
    return re.sub(f"<({GUARD}*)\\|", lambda m: f"<{m[1]}{GUARD}|", text)


def unescape(text: str) -> str:
    return re.sub(f"<({GUARD}*){GUARD}\\|", lambda m: f"<{m[1]}|", text)


def oneline(text: str) -> str:
    """Backslashes and line ends as escapes, so that a role keeps to its line."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def several_lines(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[Any], Any]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len, "escape": escape, "oneline": oneline}


# Syntax tree. Expressions: Const, Name, Item, Call (an operation on values). Statements: Put, For, If, Assign, Generation.
class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Call(NamedTuple):
    does: Callable[..., Any]
    args: tuple


class Either(NamedTuple):
    """``and`` and ``or``, which look at their right side only where they must."""

    left: Any
    right: Any
    stop: bool


class Put(NamedTuple):
    what: Any


class For(NamedTuple):
    name: str
    over: Any
    body: list


class If(NamedTuple):
    cases: list  # of (condition, body)


class Assign(NamedTuple):
    name: str
    value: Any


class Generation(NamedTuple):
    body: list


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+~|.()\[\]]))")
_KEYWORDS = {"and", "or", "not", "in", "true", "false", "none"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] > 2 else ""

    def take(self, *wanted: str) -> str:
        if (found := self.peek()) in wanted and found:
            self.at += 1
            return found
        return ""

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def whole(self) -> Any:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Either(left, self.both(), True)
        return left

    def both(self) -> Any:
        left = self.inverse()
        while self.take("and"):
            left = Either(left, self.inverse(), False)
        return left

    def inverse(self) -> Any:
        return Call(lambda x: not x, (self.inverse(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        left = self.joined()
        does = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b}
        while op := self.take(*does):
            left = Call(does[op], (left, self.joined()))
        return left

    def joined(self) -> Any:
        left = self.filtered()
        while op := self.take("+", "~"):
            left = Call((lambda a, b: a + b) if op == "+" else (lambda a, b: f"{a}{b}"), (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        value = self.item()
        while self.take("|"):
            if (name := self.peek()) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Call(FILTERS[name], (value,))
        return value

    def item(self) -> Any:
        value = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                value = Item(value, Const(self.tokens[self.at][1] if self.peek() else self.need("a name")))
                self.at += 1
            else:
                value = Item(value, self.either())
                self.need("]")
        return value

    def atom(self) -> Any:
        if self.take("("):
            value = self.either()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(text))
        if kind == 3 and text in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[text])
        if kind == 3 and text not in _KEYWORDS:
            return Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list:
    """Syntax tree of a template."""
    parts: list[tuple[str, str]] = []  # (kind, content): text, put or tag
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if m[0][2] == "-" else text))
        strip = m[0][-3] == "-"
        if m[1] is not None:
            parts.append(("put", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    parts.reverse()

    def body(*ends: str) -> tuple[list, str]:
        out: list = []
        while parts:
            kind, content = parts.pop()
            if kind == "text":
                out += [Put(Const(content))] if content else []
            elif kind == "put":
                out.append(Put(_Expression(content).whole()))
            else:
                word, _, rest = content.partition(" ")
                if word in ends:
                    return out, content
                if word == "for" and (m := re.fullmatch(r"(\w+) in (.+)", rest.strip(), re.S)):
                    out.append(For(m[1], _Expression(m[2]).whole(), body("endfor")[0]))
                elif word == "if":
                    cases, end = [], content
                    while end.startswith(("if", "elif")):
                        inner, after = body("elif", "else", "endif")
                        cases.append((_Expression(end.partition(" ")[2]).whole(), inner))
                        end = after
                    if end == "else":
                        cases.append((Const(True), body("endif")[0]))
                    out.append(If(cases))
                elif word == "set" and (m := re.fullmatch(r"(\w+) *= *(.+)", rest.strip(), re.S)):
                    out.append(Assign(m[1], _Expression(m[2]).whole()))
                elif word == "generation":
                    out.append(Generation(body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {content!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return out, ""

    return body()[0]


def fold(tree: Any) -> Any:
    """The same tree with constant expressions computed, dead branches gone and neighbouring text joined."""
    if isinstance(tree, list):
        out: list = []
        for x in map(fold, tree):
            if isinstance(x, If) and (not x.cases or x.cases[0][0] == Const(True)):
                out += x.cases[0][1] if x.cases else []
            elif isinstance(x, Put) and isinstance(x.what, Const) and out and isinstance(out[-1], Put) and isinstance(out[-1].what, Const):
                out[-1] = Put(Const(f"{out[-1].what.value}{x.what.value}"))
            else:
                out.append(x)
        return out
    if isinstance(tree, Call):
        args = tuple(map(fold, tree.args))
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(tree.does(*(a.value for a in args)))
            except TypeError:
                pass  # a fault that the template has only where it comes this far
        return Call(tree.does, args)
    if isinstance(tree, Either):
        left, right = fold(tree.left), fold(tree.right)
        return (left if bool(left.value) == tree.stop else right) if isinstance(left, Const) else Either(left, right, tree.stop)
    if isinstance(tree, Item):
        return Item(fold(tree.of), fold(tree.key))
    if isinstance(tree, Put):
        return Put(fold(tree.what))
    if isinstance(tree, For):
        return For(tree.name, fold(tree.over), fold(tree.body))
    if isinstance(tree, Assign):
        return Assign(tree.name, fold(tree.value))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body))
    if isinstance(tree, If):
        cases = []
        for when, inner in ((fold(w), fold(b)) for w, b in tree.cases):
            if isinstance(when, Const) and not when.value:
                continue
            cases.append((Const(True) if isinstance(when, Const) else when, inner))
            if isinstance(when, Const):
                break
        return If(cases)
    return tree


Scope = dict[str, Any]
Pieces = list[tuple[str, bool]]


def _value(tree: Any) -> Callable[[Scope], Any]:
    if isinstance(tree, Const):
        return lambda scope, v=tree.value: v
    if isinstance(tree, Name):
        def look(scope: Scope, name: str = tree.name) -> Any:
            if name not in scope:
                raise TemplateError(f"{name!r} is not defined")
            return scope[name]
        return look
    if isinstance(tree, Item):
        of, key = _value(tree.of), _value(tree.key)

        def item(scope: Scope) -> Any:
            held = of(scope)
            if not isinstance(held, (dict, list)):
                raise TemplateError("only messages and lists have items")
            return held[key(scope)]
        return item
    if isinstance(tree, Either):
        left, right, stop = _value(tree.left), _value(tree.right), tree.stop
        return lambda scope: v if bool(v := left(scope)) == stop else right(scope)
    args = [_value(a) for a in tree.args]
    if len(args) == 1:
        return lambda scope, does=tree.does, a=args[0]: does(a(scope))
    return lambda scope, does=tree.does, a=args[0], b=args[1]: does(a(scope), b(scope))


def _statements(trees: list, marked: bool) -> Callable[[Scope, Pieces], None]:
    steps = [_statement(t, marked) for t in trees]

    def run(scope: Scope, out: Pieces) -> None:
        for step in steps:
            step(scope, out)
    return steps[0] if len(steps) == 1 else run


def _statement(tree: Any, marked: bool) -> Callable[[Scope, Pieces], None]:
    if isinstance(tree, Put):
        if isinstance(tree.what, Const):
            piece = (str(tree.what.value), marked)
            return lambda scope, out: out.append(piece)
        what = _value(tree.what)
        return lambda scope, out: out.append((str(what(scope)), marked))
    if isinstance(tree, Assign):
        value = _value(tree.value)
        return lambda scope, out, name=tree.name: scope.__setitem__(name, value(scope))
    if isinstance(tree, Generation):
        inside = _statements(tree.body, True)

        def generation(scope: Scope, out: Pieces) -> None:
            n = len(out)
            inside(scope, out)
            out[n:] = [("".join(t for t, _ in out[n:]), True)]  # one piece, so that spans stay apart
        return generation
    if isinstance(tree, For):
        over, inside = _value(tree.over), _statements(tree.body, marked)

        def loop(scope: Scope, out: Pieces, name: str = tree.name) -> None:
            items = over(scope)
            inner = dict(scope)
            for i, x in enumerate(items):
                inner[name] = x
                inner["loop"] = {"index0": i, "first": i == 0, "last": i == len(items) - 1}
                inside(inner, out)
        return loop
    cases = [(_value(when), _statements(inner, marked)) for when, inner in tree.cases]

    def branch(scope: Scope, out: Pieces) -> None:
        for when, inside in cases:
            if when(scope):
                return inside(scope, out)
    return branch


class Formatted(NamedTuple):
    """A rendered conversation and the spans, in code points, of what is under the loss mask."""

    text: str
    spans: list[tuple[int, int]]


@lru_cache(maxsize=64)
def compile_template(source: str = TEMPLATE) -> Callable[[list[dict[str, str]]], Formatted]:
    render = _statements(fold(parse(source)), False)

    def run(messages: list[dict[str, str]]) -> Formatted:
        out: Pieces = []
        render({"messages": messages}, out)
        spans, at = [], 0
        for text, marked in out:
            if marked:
                spans.append((at, at + len(text)))
            at += len(text)
        return Formatted("".join(t for t, _ in out), spans)
    return run


_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns in an output of the default template."""
    return [(unescape(several_lines(role)), unescape(text)) for role, text in _TURN.findall(formatted)]


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted text, and the spans under the loss mask."""
    compile_template(template)  # faults show here, not in tasks
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn"), role, text)))
    grouped = rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = compile_template(template)
        for b in batches:
            done = [run([{"role": t["role"], "text": t["text"]} for t in turns]) for turns in b["turns"]]
            yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "n_turns": b["turns"].map(len), "formatted": [d.text for d in done], "spans": [[{"start": s, "end": e} for s, e in d.spans] for d in done]})

    return grouped.mapInPandas(render, "conv_id long, n_turns long, formatted string, spans array<struct<start: long, end: long>>")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations."""
    said = f"{END}{START}assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turns = b["formatted"].map(read_back)
            loss = ["".join(unescape(f[s["start"] : s["end"]]) for s in spans) for f, spans in zip(b["formatted"], b["spans"])]
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "n_turns": turns.map(len), "turns_sha256": [sha("".join(f"{r}\n{t}\n" for r, t in ts)) for ts in turns], "loss_chars": [len(x) for x in loss], "loss_sha256": [sha(x) for x in loss], "formatted_chars": b["formatted"].map(len)})

    return format_conversations(rows.unionByName(own)).mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
