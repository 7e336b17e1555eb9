"""Values written as JavaScript literals, index-referenced payloads and data URIs. Nothing is executed."""

from __future__ import annotations

import base64
import json
import re
from typing import Any
from urllib.parse import unquote_to_bytes

_NUMBER = re.compile(r"[-+]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_WORDS = {"true": True, "false": False, "null": None, "undefined": None, "NaN": None, "Infinity": None}
DEPTH = 200


class LiteralError(ValueError):
    """A text that isn't a literal."""


class _Reader:
    """Recursive descent over objects, arrays, strings, templates without holes, numbers and known names."""

    def __init__(self, text: str, names: dict[str, Any]) -> None:
        self.text, self.at, self.names = text, 0, names

    def blank(self) -> None:
        self.at = _BLANK.match(self.text, self.at).end()  # type: ignore[union-attr]

    def peek(self) -> str:
        self.blank()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> bool:
        if self.peek() == sign:
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise LiteralError(f"no {sign!r} at {self.at}")

    def value(self, depth: int = 0) -> Any:
        if depth > DEPTH:
            raise LiteralError("too deep")
        sign = self.peek()
        if sign == "{":
            self.at += 1
            out: dict[str, Any] = {}
            while not self.take("}"):
                key = self.string() if self.peek() in "'\"" else self.key()
                self.need(":")
                out[key] = self.value(depth + 1)
                if not self.take(","):
                    self.need("}")
                    break
            return out
        if sign == "[":
            self.at += 1
            items: list[Any] = []
            while not self.take("]"):
                if self.take(","):
                    items.append(None)  # a hole
                    continue
                items.append(self.value(depth + 1))
                if not self.take(","):
                    self.need("]")
                    break
            return items
        if sign and sign in "'\"`":
            return self.string()
        if sign == "!":
            self.at += 1
            return not self.value(depth + 1)
        if sign == "(":
            self.at += 1
            inner = self.value(depth + 1)
            self.need(")")
            return inner
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            raw = m.group().lstrip("+")
            return int(raw, 16) if "x" in raw.lower() else float(raw) if re.search(r"[.eE]", raw) else int(raw)
        name = self.key()
        if name == "void":
            self.value(depth + 1)
            return None
        if name in _WORDS:
            return _WORDS[name]
        if name in self.names:
            return self.names[name]
        raise LiteralError(f"no value of {name!r}")

    def key(self) -> str:
        self.blank()
        if m := _NAME.match(self.text, self.at) or _NUMBER.match(self.text, self.at):
            self.at = m.end()
            return m.group()
        raise LiteralError(f"nothing to read at {self.at}")

    def string(self) -> str:
        quote, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                return "".join(out)
            if quote == "`" and c == "$" and self.text[self.at : self.at + 1] == "{":
                raise LiteralError("a template with holes")
            if c != "\\":
                out.append(c)
                continue
            c = self.text[self.at : self.at + 1]
            self.at += 1
            if c in ("x", "u"):
                m = re.compile(r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4})" if c == "u" else r"()([0-9a-fA-F]{2})").match(self.text, self.at)
                if not m:
                    raise LiteralError("a bad escape")
                self.at = m.end()
                out.append(chr(int(m.group(1) or m.group(2), 16)))
            elif c != "\n":
                out.append(_ESCAPES.get(c, c))
        raise LiteralError("a string isn't closed")


_CALL = re.compile(r"\s*\(?\s*function\s*\(([^)]*)\)\s*\{\s*return\s*", re.S)


class _Hole(str):
    """The name of an argument where its value goes."""


def _filled(shape: Any, values: dict[str, Any]) -> Any:
    if isinstance(shape, _Hole):
        return values.get(str(shape))
    if isinstance(shape, dict):
        return {k: _filled(v, values) for k, v in shape.items()}
    return [_filled(v, values) for v in shape] if isinstance(shape, list) else shape


def read_literal(text: str) -> Any:
    """The value of JSON or a JavaScript literal; `(function(a,b){return {...}}(1,2))` with its arguments put in."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    names: dict[str, Any] = {}
    if m := _CALL.match(text):
        body = _Reader(text, {n.strip(): _Hole(n.strip()) for n in m.group(1).split(",") if n.strip()})
        body.at = m.end()
        shape = body.value()
        body.take(";")
        body.need("}")
        body.take(")")
        body.need("(")
        values: list[Any] = []
        while not body.take(")"):
            values.append(body.value())
            body.take(",")
        return _filled(shape, dict(zip((n.strip() for n in m.group(1).split(",")), values)))
    reader = _Reader(text, names)
    found = reader.value()
    if reader.peek() not in ("", ";"):
        raise LiteralError(f"more after the literal at {reader.at}")
    return found


def unflatten(flat: Any) -> Any:
    """The value of an index-referenced payload: numbers in objects and arrays are places in the list; -1 and the like are null."""
    if not isinstance(flat, list) or not flat:
        return flat
    made: dict[int, Any] = {}

    def at(place: Any, depth: int = 0) -> Any:
        if not isinstance(place, int) or place < 0 or place >= len(flat) or depth > DEPTH:
            return None
        if place in made:
            return made[place]
        value = flat[place]
        if isinstance(value, dict):
            out: Any = made.setdefault(place, {})
            out.update({k: at(v, depth + 1) for k, v in value.items()})
        elif isinstance(value, list):
            if value and isinstance(value[0], str):
                kind, rest = value[0], value[1:]
                out = made[place] = rest[0] if kind == "Date" and rest else at(rest[0], depth + 1) if len(rest) == 1 else [at(v, depth + 1) for v in rest]
            else:
                out = made.setdefault(place, [])
                out.extend(at(v, depth + 1) for v in value)
        else:
            out = made[place] = value
        return out

    return at(0)


def data_uri(uri: str) -> tuple[bytes, str]:
    """The bytes and media type of a data URI, base64 or percent-encoded."""
    m = re.fullmatch(r"data:([^,;]*)((?:;[^,;]*)*),(.*)", uri, re.S)
    if not m:
        raise ValueError("not a data URI")
    body = unquote_to_bytes(m.group(3))
    kind = m.group(1).strip().lower() or "text/plain"
    return (base64.b64decode(body + b"=" * (-len(body) % 4)) if ";base64" in m.group(2).lower() else body), kind


def schema_type(name: str) -> str:
    """A vocabulary's type without its prefix."""
    return re.sub(r"^(?:https?://schema\.org/|schema:)", "", name)
