"""Chat formatting with a small compiled template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python
closures that stream a conversation's pieces with a mark on those the model shall learn
(`{% generation %}`). The language is sandboxed: it knows literals, names, attributes of a
message, `==`, `!=`, `+`, `not`, `and`, `or`, the filters below, `if`/`elif`/`else`, one kind of
`for` and `generation`; no calls, imports or Python attributes.

Control strings in texts are escaped reversibly: `<|` becomes `<\\|`, and every `<\\..\\|` takes
one more backslash, so the output holds a control string only where the template wrote it.

Conversations stream through their task turn by turn; only one turn is held at a time. A large
conversation leaves as several parts, cut behind a turn.

Defined results: null roles and texts are empty; a null conv_id is a conversation of its own;
turns come by number (null first), ties by role and text; repeated rows are turns of their own. Very long turns are
rendered whole, a turn at a time; an empty table gives no conversations; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for message in messages %}"
    "{{ '<|im_start|>' + message.role | label }}{{ '\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|im_end|>' }}{{ '\n' }}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def label(role: str) -> str:
    """A role on one line, without control strings."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unlabel(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "label": label, "trim": str.strip, "upper": str.upper, "lower": str.lower}

# ---- syntax tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Attr:
    of: object
    name: str


@dataclass(frozen=True)
class Apply:
    op: str  # a filter or one of == != + not and or
    args: tuple


@dataclass(frozen=True)
class Show:
    what: object


@dataclass(frozen=True)
class If:
    cases: tuple  # (test, body) pairs; the last test may be Const(True)


@dataclass(frozen=True)
class For:
    var: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(\d+)|(==|!=|[+|.()]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    pass


class Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip(" \t")
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append(m)
            at = m.end()
            if not source[at:].strip():
                break
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][0].strip() if self.at < len(self.tokens) else None

    def next(self) -> re.Match:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> object:
        out = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return out

    def chain(self, ops: tuple[str, ...], below: Callable[[], object]) -> object:
        out = below()
        while self.peek() in ops:
            op = self.next()[0].strip()
            out = Apply(op, (out, below()))
        return out

    def either(self) -> object:
        return self.chain(("or",), lambda: self.chain(("and",), self.negation))

    def negation(self) -> object:
        if self.peek() == "not":
            self.next()
            return Apply("not", (self.negation(),))
        return self.chain(("==", "!="), lambda: self.chain(("+",), self.filtered))

    def filtered(self) -> object:
        out = self.atom()
        while self.peek() in ("|", "."):
            op, name = self.next()[0].strip(), self.next()[2]
            if not name or name.startswith("_"):
                raise TemplateError("a plain name is expected")
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Apply(name, (out,)) if op == "|" else Attr(out, name)
        return out

    def atom(self) -> object:
        m = self.next()
        if m[1]:
            return Const(re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[0]), m[1][1:-1], flags=re.S))
        if m[2]:
            return Const({"true": True, "false": False, "none": None}[m[2]]) if m[2] in ("true", "false", "none") else Name(m[2])
        if m[3]:
            return Const(int(m[3]))
        if m[4] == "(":
            out = self.either()
            if self.next()[0].strip() != ")":
                raise TemplateError("a bracket stays open")
            return out
        raise TemplateError(f"unexpected {m[0]!r}")


def parse(source: str) -> tuple:
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out: list[object] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Show(Expression(part[2:-2]).whole()))
            elif not part.startswith("{%"):
                if part:
                    out.append(Show(Const(part)))
            else:
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(out), f"{word} {rest}".strip()
                if word == "for":
                    m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip())
                    if not m:
                        raise TemplateError(f"unexpected {rest!r}")
                    out.append(For(m[1], Expression(m[2]).whole(), body("endfor")[0]))
                elif word == "generation":
                    out.append(Generation(body("endgeneration")[0]))
                elif word == "if":
                    cases, test, end = [], Expression(rest).whole(), ""
                    while end != "endif":
                        inner, end = body("elif", "else", "endif")
                        cases.append((test, inner))
                        test = Const(True) if end == "else" else Expression(end[5:]).whole() if end.startswith("elif") else None
                    out.append(If(tuple(cases)))
                else:
                    raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), ""

    return body()[0]


# ---- folding -----------------------------------------------------------------------------------


def _apply(op: str, args: list) -> object:
    if op in FILTERS:
        return FILTERS[op]("" if args[0] is None else str(args[0]))
    if op == "+":
        return "".join("" if a is None else str(a) for a in args)
    return {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b}[op](*args)


def fold_value(e: object) -> object:
    if isinstance(e, Apply):
        args = tuple(map(fold_value, e.args))
        return Const(_apply(e.op, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Apply(e.op, args)
    return Attr(fold_value(e.of), e.name) if isinstance(e, Attr) else e


def fold(body: tuple) -> tuple:
    """Evaluate what is constant, drop branches that can't be taken, join neighbouring texts."""
    out: list[object] = []
    for node in body:
        if isinstance(node, Show):
            value = fold_value(node.what)
            if isinstance(value, Apply) and value.op == "+":  # a constant beginning joins the text before
                out += [Show(v) for v in value.args]
            else:
                out.append(Show(value))
        elif isinstance(node, For):
            out.append(For(node.var, fold_value(node.over), fold(node.body)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body)))
        else:
            cases = []
            for test, inner in ((fold_value(t), fold(b)) for t, b in node.cases):
                if not (isinstance(test, Const) and not test.value):
                    cases.append((test, inner))
                if isinstance(test, Const) and test.value:
                    break
            if cases and isinstance(cases[0][0], Const):
                out += cases[0][1]
            elif cases:
                out.append(If(tuple(cases)))
    joined: list[object] = []
    for node in out:
        both = joined and isinstance(node, Show) and isinstance(node.what, Const) and isinstance(joined[-1], Show) and isinstance(joined[-1].what, Const)
        if both:
            joined[-1] = Show(Const(_apply("+", [joined[-1].what.value, node.what.value])))
        else:
            joined.append(node)
    return tuple(joined)


# ---- closures ----------------------------------------------------------------------------------

Pieces = Iterator[tuple[str, bool]]


def value_of(e: object) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        return lambda env, n=e.name: env.get(n)
    if isinstance(e, Attr):
        return lambda env, f=value_of(e.of), n=e.name: x.get(n) if isinstance(x := f(env), dict) else None
    args = [value_of(a) for a in e.args]
    if e.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.op == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env, op=e.op: _apply(op, [a(env) for a in args])


def writer(body: tuple, learn: bool = False) -> Callable[[dict], Pieces]:
    steps: list[Callable[[dict], Pieces]] = []
    for node in body:
        if isinstance(node, Show):

            def show(env: dict, f: Callable = value_of(node.what)) -> Pieces:
                value = f(env)
                yield ("" if value is None else str(value)), learn

            steps.append(show)
        elif isinstance(node, Generation):
            steps.append(writer(node.body, True))
        elif isinstance(node, For):

            def loop(env: dict, over: Callable = value_of(node.over), var: str = node.var, inner: Callable = writer(node.body, learn)) -> Pieces:
                for item in over(env) or ():
                    yield from inner({**env, var: item})

            steps.append(loop)
        else:

            def branch(env: dict, cases: tuple = tuple((value_of(t), writer(b, learn)) for t, b in node.cases)) -> Pieces:
                for test, inner in cases:
                    if test(env):
                        yield from inner(env)
                        return

            steps.append(branch)
    return lambda env: chain.from_iterable(step(env) for step in steps)


def compile_template(source: str) -> Callable[[dict], Pieces]:
    """A closure from the names a template uses to its pieces (text, whether to learn it)."""
    return writer(fold(parse(source)))


# ---- Spark -------------------------------------------------------------------------------------

PART = "conv_id long, part long, formatted string, learn array<struct<start: long, end: long>>"


def format_conversations(turns: DataFrame, template: str = CHATML, part_chars: int = 1 << 20) -> DataFrame:
    """conv_id, part, formatted, learn (spans of the part under the loss mask).

    A part ends with the first end of a turn behind `part_chars`. Parts of a conversation lie in
    one partition, in order.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        ended = False

        def flat() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)

        source = flat()
        ahead = next(source, None)

        def messages(conv: object) -> Iterator[dict]:
            nonlocal ahead, ended
            while ahead is not None and ahead[0] == conv:
                turn, ahead = ahead, next(source, None)
                yield {"role": turn[1], "text": turn[2]}
                ended = True

        def out(conv: object, part: int, pieces: list, spans: list) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([part]), pa.array(["".join(pieces)]), pa.array([spans], kind)], ["conv_id", "part", "formatted", "learn"]
            )

        while ahead is not None:
            conv, part, size, ended = ahead[0], 0, 0, False
            pieces, spans = [], []
            for text, learn in render({"messages": messages(conv)}):
                if ended and size >= part_chars:  # a turn is complete
                    yield out(conv, part, pieces, spans)
                    part, size, pieces, spans = part + 1, 0, [], []
                ended = False
                if learn:
                    spans.append({"start": size, "end": size + len(text)})
                pieces.append(text)
                size += len(text)
            for _ in messages(conv):  # of a template that doesn't read them
                pass
            yield out(conv, part, pieces, spans)

    return dealt.mapInArrow(run, PART)


TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what the formatted parts hold; parts of a conversation lie together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row(s: dict) -> pa.RecordBatch:
            values = [s["conv"], s["turns"], s["digest"].hexdigest(), s["loss"], s["loss_digest"].hexdigest(), s["chars"]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], NAMES)

        for b in batches:
            for conv, part, text, learn in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "learn")), strict=True):
                if part == 0:
                    if now:
                        yield row(now)
                    now = {"conv": conv, "turns": 0, "digest": hashlib.sha256(), "loss": 0, "loss_digest": hashlib.sha256(), "chars": 0}
                for m in TURN.finditer(text):
                    now["turns"] += 1
                    now["digest"].update(f"{unlabel(m[1])}\n{unescape(m[2])}\n".encode())
                for span in learn:
                    said = unescape(text[span["start"] : span["end"]])
                    now["loss"] += len(said)
                    now["loss_digest"].update(said.encode())
                now["chars"] += len(text)
        if now:
            yield row(now)

    return parts.mapInArrow(run, DIGEST)


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
