"""Chat formatting with a template compiler.

The template language is sandboxed: literals, names, fields of dicts, comparisons,
and/or/not, +, filters from a fixed table, if/elif/else, for, set, and generation
blocks. No calls, no attributes of objects, no imports. A template is parsed into
a syntax tree, constants are folded, and the tree becomes nested Python closures
that append to a buffer; generation blocks note the spans they wrote, which are
the loss mask.

The default template marks turns with ``[INST]``, ``[/INST]``, ``[ROLE]``,
``[/ROLE]``, ``<s>`` and ``</s>``. Inside texts and roles the filter ``guard``
doubles each backslash and breaks each control string after its first character
by backslash-hyphen, so that none is left in them; ``unguard`` undoes it exactly.

Plan: rows are hashed by conv_id and sorted by (conv_id, turn, role, text) within
partitions, which spills; a task streams them turn by turn with the state of one
conversation (a hash and counters), so that a conversation of any length takes
bounded memory. Only its turns' order makes it one task's work.

Defined cases: null and repeated turns sort first and by role, then text; a null
text or role is empty; a null conv_id is a conversation; an empty table gives only
what the caller adds; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm.common import table, to_batches

CONTROLS = ("[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>")
ESCAPE, BREAK = "\\", "\\-"
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))


def guard(text: Any) -> str:
    """The text without control strings, reversibly."""
    doubled = ("" if text is None else str(text)).replace(ESCAPE, ESCAPE * 2)
    return _CONTROL.sub(lambda m: m.group()[0] + BREAK + m.group()[1:], doubled)


def unguard(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "" if m.group(1) == "-" else m.group(1), text, flags=re.S)


TEMPLATE = (
    "{%- for m in messages -%}"
    "{%- if m.role == 'user' -%}{{ '<s>' + '[INST]' }}{{ m.text | guard }}{{ '[/INST]' }}"
    "{%- elif m.role == 'assistant' -%}{% generation %}{{ m.text | guard }}{% endgeneration %}{{ '</s>' }}"
    "{%- else -%}{{ '[ROLE]' }}{{ m.role | guard }}{{ '[/ROLE]' }}{{ m.text | guard }}{{ '</s>' }}"
    "{%- endif -%}"
    "{%- endfor -%}"
)


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


FILTERS: dict[str, Callable[[Any], Any]] = {
    "guard": guard,
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
}

_PARTS = re.compile(r"\{%-?(.*?)-?%\}|\{\{-?(.*?)-?\}\}|\{#(.*?)#\}", re.S)
_LEXEMES = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>().|\[\]]))")


def _lex(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _LEXEMES.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        at = m.end()
        if m.group(1) is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e.group(1), e.group(1)), m.group(1)[1:-1])))
        elif m.group(2) is not None:
            out.append(("const", int(m.group(2))))
        else:
            out.append(("name", m.group(3)) if m.group(3) else ("op", m.group(4)))
    return out


class _Expression:
    """Recursive descent: or, and, not, comparison, +, filters, fields."""

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _lex(source), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, kind: str, value: Any = None) -> bool:
        if self.peek() == (kind, value):
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("name", "or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("name", "and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("name", "not") else self.compared()

    def compared(self) -> tuple:
        tree = self.sum()
        kind, value = self.peek()
        if kind == "op" and value in ("==", "!=", "<", ">", "<=", ">="):
            self.at += 1
            return (value, tree, self.sum())
        return tree

    def sum(self) -> tuple:
        tree = self.filtered()
        while self.take("op", "+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.field()
        while self.take("op", "|"):
            kind, value = self.peek()
            if kind != "name" or value not in FILTERS:
                raise TemplateError(f"no filter {value!r}")
            self.at += 1
            tree = ("filter", value, tree)
        return tree

    def field(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "const":
            tree: tuple = ("const", value)
        elif kind == "name":
            tree = ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        elif (kind, value) == ("op", "("):
            tree = self.either()
            if not self.take("op", ")"):
                raise TemplateError("a bracket isn't closed")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while True:
            if self.take("op", "."):
                kind, name = self.peek()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no field {name!r}")
                self.at += 1
                tree = ("field", tree, name)
            elif self.take("op", "["):
                tree = ("item", tree, self.either())
                if not self.take("op", "]"):
                    raise TemplateError("a bracket isn't closed")
            else:
                return tree


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
}


def fold(tree: tuple) -> tuple:
    """The expression, each part without names computed."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](inner[1])) if inner[0] == "const" else (kind, tree[1], inner)
    if kind == "field":
        return (kind, fold(tree[1]), tree[2])
    parts = [fold(t) for t in tree[1:]]
    if all(p[0] == "const" for p in parts) and kind != "item":
        return ("const", _evaluator((kind, *parts))({}))
    return (kind, *parts)


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _evaluator(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "field":
        inner, name = _evaluator(tree[1]), tree[2]
        return lambda scope: _item(inner(scope), name)
    if kind == "filter":
        apply, inner = FILTERS[tree[1]], _evaluator(tree[2])
        return lambda scope: apply(inner(scope))
    a = _evaluator(tree[1])
    if kind == "not":
        return lambda scope: not a(scope)
    b = _evaluator(tree[2])
    if kind == "item":
        return lambda scope: _item(a(scope), b(scope))
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    operate = _BINARY[kind]
    return lambda scope: operate(a(scope), b(scope))


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of ('text', s), ('out', e), ('if', ...), ('for', ...), ('set', ...), ('generation', ...)."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _PARTS.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if m.group()[2] == "-" else text))
        if m.group(3) is None:
            parts.append(("block", m.group(1).strip()) if m.group(1) is not None else ("out", m.group(2)))
        at, trim = m.end(), m.group()[-3] == "-"
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    tree, where, ended = _body(parts, 0, ())
    if ended:
        raise TemplateError(f"unexpected {ended}")
    return tree


def _body(parts: list[tuple[str, str]], at: int, until: tuple[str, ...]) -> tuple[list[tuple], int, str]:
    body: list[tuple] = []
    while at < len(parts):
        kind, value = parts[at]
        at += 1
        if kind == "text":
            if value:
                body.append(("text", value))
        elif kind == "out":
            body.append(("out", fold(_Expression(value).whole())))
        else:
            word, _, rest = value.partition(" ")
            if word in until:
                return body, at, value
            if word == "if":
                branches, ended, test = [], "", fold(_Expression(rest).whole())
                while True:
                    own, at, ended = _body(parts, at, ("elif", "else", "endif"))
                    branches.append((test, own))
                    word, _, rest = ended.partition(" ")
                    if word == "endif":
                        break
                    test = fold(_Expression(rest).whole()) if word == "elif" else ("const", True)
                body.append(("if", branches))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"for {rest}")
                own, at, _ = _body(parts, at, ("endfor",))
                body.append(("for", m.group(1), fold(_Expression(m.group(2)).whole()), own))
            elif word == "generation":
                own, at, _ = _body(parts, at, ("endgeneration",))
                body.append(("generation", own))
            elif word == "set" and (m := re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.+)", rest, re.S)):
                body.append(("set", m.group(1), fold(_Expression(m.group(2)).whole())))
            else:
                raise TemplateError(f"no block {value!r}")
    if until:
        raise TemplateError(f"no {until[-1]}")
    return body, at, ""


class Buffer:
    """What a rendering wrote, and the spans of its generation blocks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _closure(body: list[tuple]) -> Callable[[dict, Buffer], None]:
    steps = []
    merged: list[tuple] = []
    for node in body:  # constant output is text, and neighbouring text is one
        if node[0] == "out" and node[1][0] == "const":
            node = ("text", "" if node[1][1] is None else str(node[1][1]))
        if node[0] == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + node[1])
        else:
            merged.append(node)
    for node in merged:
        steps.append(_step(node))
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Buffer) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: tuple) -> Callable[[dict, Buffer], None]:
    kind = node[0]
    if kind == "text":
        return lambda scope, out, text=node[1]: out.add(text)
    if kind == "out":
        value = _evaluator(node[1])

        def write(scope: dict, out: Buffer) -> None:
            found = value(scope)
            out.add("" if found is None else str(found))

        return write
    if kind == "set":
        name, value = node[1], _evaluator(node[2])
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "generation":
        inner = _closure(node[1])

        def generate(scope: dict, out: Buffer) -> None:
            start = out.length
            inner(scope, out)
            out.spans.append((start, out.length))

        return generate
    if kind == "for":
        name, values, inner = node[1], _evaluator(node[2]), _closure(node[3])

        def loop(scope: dict, out: Buffer) -> None:
            for x in values(scope) or ():
                inner({**scope, name: x}, out)

        return loop
    branches = [(_evaluator(test), _closure(own)) for test, own in node[1] if test != ("const", False)]

    def choose(scope: dict, out: Buffer) -> None:
        for test, own in branches:
            if test(scope):
                return own(scope, out)

    return choose


class Template:
    """A compiled template."""

    def __init__(self, source: str = TEMPLATE) -> None:
        self.tree = parse(source)
        self.run = _closure(self.tree)

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the spans of its generation blocks."""
        out = Buffer()
        self.run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    def by_turn(self) -> bool:
        """Whether rendering turns one by one gives the whole rendering."""
        return len(self.tree) == 1 and self.tree[0][0] == "for" and self.tree[0][2] == ("name", "messages") and not _sets(self.tree)


def _sets(body: list[tuple]) -> bool:
    inner = {"for": lambda n: [n[3]], "generation": lambda n: [n[1]], "if": lambda n: [b for _, b in n[1]]}
    return any(n[0] == "set" or any(_sets(b) for b in inner.get(n[0], lambda n: [])(n)) for n in body)


def read_turn(formatted: str) -> tuple[str, str]:
    """role and text of one formatted turn of the default template."""
    if formatted.startswith("<s>[INST]") and formatted.endswith("[/INST]"):
        return "user", unguard(formatted[9:-7])
    if formatted.startswith("[ROLE]"):
        role, _, rest = formatted[6:].partition("[/ROLE]")
        return unguard(role), unguard(rest[:-4])
    return "assistant", unguard(formatted[:-4])


_TURNS = re.compile(r"<s>\[INST\].*?\[/INST\]|\[ROLE\].*?\[/ROLE\].*?</s>|.*?</s>", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Every (role, text) of a formatted conversation of the default template."""
    return [read_turn(m.group()) for m in _TURNS.finditer(formatted)]


FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, formatted, loss_start, loss_end: the formatted text turn by turn.

    A conversation is its parts' concatenation, and the spans of the loss mask are
    offsets in the part. The rows of a conversation stand together in order. The
    template is one loop over the messages that sets no names.
    """
    if not Template(template).by_turn():
        raise TemplateError("turn by turn, a template is one loop over messages and sets no names")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        compiled, last, part = Template(template), object(), 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                part = part + 1 if conv_id == last else 0
                last = conv_id
                formatted, spans = compiled.render([{"role": role or "", "text": text or ""}])
                yield conv_id, part, formatted, [a for a, _ in spans], [b for _, b in spans]

    ordered = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        lambda batches: to_batches(rows(batches), FORMATTED), "conv_id long, part long, formatted string, loss_start array<long>, loss_end array<long>"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the rows of format_turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        state: list[Any] | None = None
        for batch in batches:
            for conv_id, part, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part == 0:
                    if state:
                        yield state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    loss = unguard(text[a:b])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(text)
        if state:
            yield state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    return formatted.mapInArrow(lambda batches: to_batches(rows(batches), schema), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digests(format_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)))


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), guarded AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(\[|<)(INST\]|/INST\]|ROLE\]|/ROLE\]|s>|/s>)', '\1\\-\2', 'g') AS safe,
    regexp_replace(replace(role, '\', '\\'), '(\[|<)(INST\]|/INST\]|ROLE\]|/ROLE\]|s>|/s>)', '\1\\-\2', 'g') AS safe_role FROM rows_
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 ELSE 17 + length(safe_role) END) AS BIGINT) AS formatted_chars
FROM guarded GROUP BY conv_id
"""
