"""Embedded data: JSON blobs flattened to leaves, shapes and fingerprints."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspan.operators.html import per_page
from fieldspan.operators.literals import read_literal, schema_type, unflatten

SKIPPED = {"@context", "@id"}


def step(parent: str, key: str) -> str:
    """A path with one more key, quoted where it holds a path's own signs."""
    return f"{parent}[{json.dumps(key)}]" if re.search(r"[.\[\]\"]", key) else f"{parent}.{key}"


def leaves(value: Any, path: str = "$", shape: str = "$") -> Iterator[tuple[str, str, str]]:
    """(path with indices, shape without, value) of every leaf; nulls, blank texts and JSON-LD bookkeeping are skipped."""
    stack = [(value, path, shape)]
    while stack:
        v, p, s = stack.pop()
        if isinstance(v, dict):
            stack += [(x, step(p, k), step(s, k)) for k, x in reversed(v.items()) if k not in SKIPPED]
        elif isinstance(v, list):
            stack += [(x, f"{p}[{i}]", f"{s}[]") for i, x in reversed(list(enumerate(v)))]
        elif v is not None and (not isinstance(v, str) or v.strip()):
            yield p, s, v if isinstance(v, str) else json.dumps(v)


def _read_leaves(blob: str | None) -> list[tuple[str, str, str]]:
    try:
        return list(leaves(json.loads(blob))) if blob else []
    except ValueError:
        return []


def flatten(blobs: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of ``keep``, path, shape, value of every leaf of the JSON in column blob; a blob that isn't JSON has none.

    What else is wanted of a blob is kept in the leaf's row: joined again by key, the
    blobs would be taken for small by their guessed size, and sent to the driver whole.
    """
    return per_page(blobs, key, "blob", "path string, shape string, value string", _read_leaves, keep)


def fingerprints(found: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """key, fingerprint: source, sorted types and sorted distinct shapes, hashed; values and lengths don't count."""
    shapes = found.groupBy(key).agg(F.array_sort(F.collect_set("shape")).alias("shapes"))
    joined = kinds.join(shapes, key)
    text = F.array_join(F.concat(F.array("source"), F.array_sort("types"), "shapes"), "\n")
    return joined.select(key, F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


class _Scripts(HTMLParser):
    """Scripts with their type and id, elements with data attributes and microdata."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.scripts: list[tuple[str, str]] = []
        self.data: dict[str, str] = {}
        self.meta: dict[str, str] = {}
        self.items: list[dict[str, Any]] = []
        self._script: list[str] | None = None
        self._kind = ""
        self._open: list[tuple[str, str | None, dict | None, list[str]]] = []
        self._scopes: list[dict[str, Any]] = []

    VOID = {"meta", "link", "img", "br", "input", "hr", "source", "area", "base", "col", "embed", "wbr"}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "script":
            self._script, self._kind = [], own.get("type", "").lower()
            return
        if tag == "meta" and "property" in own and "content" in own:
            self.meta.setdefault(own["property"], own["content"])
        self.data.update({k[5:]: v for k, v in own.items() if k.startswith("data-") and v.strip()})
        scope: dict[str, Any] | None = None
        if "itemscope" in own:
            scope = {"@type": own.get("itemtype", "").rsplit("/", 1)[-1]}
        prop = own.get("itemprop")
        if prop and self._scopes and scope is None:
            for name in ("content", "resource", "src", "href", "value", "datetime"):
                if name in own:
                    self._put(prop, own[name])
                    prop = None
                    break
        elif prop and self._scopes and scope is not None:
            self._put(prop, scope)
            prop = None
        elif scope is not None:
            self.items.append(scope)
        if tag not in self.VOID:
            self._open.append((tag, prop, scope, []))
            if scope is not None:
                self._scopes.append(scope)

    def _put(self, name: str, value: Any) -> None:
        held = self._scopes[-1].get(name)
        self._scopes[-1][name] = value if held is None else [*(held if isinstance(held, list) else [held]), value]

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            self._script.append(data)
        for _, prop, _, text in self._open:
            if prop:
                text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self._script is not None:
            self.scripts.append((self._kind, "".join(self._script)))
            self._script = None
            return
        if not any(t == tag for t, _, _, _ in self._open):
            return
        while self._open:
            name, prop, scope, text = self._open.pop()
            if scope is not None and self._scopes and self._scopes[-1] is scope:
                self._scopes.pop()
            if prop and self._scopes:
                self._put(prop, " ".join("".join(text).split()))
            if name == tag:
                break


def _json_ld(value: Any) -> Iterator[dict]:
    """The nodes of lists and graphs."""
    for node in value if isinstance(value, list) else [value]:
        if isinstance(node, dict):
            yield from _json_ld(node["@graph"]) if "@graph" in node else [node]


def read_blobs(html: str | None) -> list[tuple[str, str, str]]:
    """(source, type, JSON) of every embedded blob: JSON-LD, JSON scripts and state, microdata, properties, data attributes."""
    page = _Scripts()
    page.feed(html or "")
    page.close()
    out: list[tuple[str, str, str]] = []
    for kind, body in page.scripts:
        if kind == "application/ld+json":
            try:
                nodes = list(_json_ld(json.loads(body)))
            except ValueError:
                continue
            by_id = {n["@id"]: n for n in nodes if "@id" in n}
            for node in nodes:
                whole = {k: {**by_id[v["@id"]]} if isinstance(v, dict) and set(v) == {"@id"} and v["@id"] in by_id and v["@id"] != node.get("@id") else v for k, v in node.items()}
                kinds = whole.get("@type", "")
                out.append(("json_ld", schema_type(str(kinds[0] if isinstance(kinds, list) and kinds else kinds)), json.dumps(whole)))
        elif kind.endswith("json"):
            try:
                value = json.loads(body)
                out.append(("app_state", "", json.dumps(unflatten(value) if isinstance(value, list) else value)))
            except ValueError:
                continue
        elif m := re.search(r"window\.(__[A-Z_]+__)\s*=\s*(.+?)\s*;?\s*$", body, re.S):
            try:
                out.append(("app_state", m.group(1), json.dumps(read_literal(m.group(2)))))
            except ValueError:
                continue
    out += [("microdata", str(i["@type"]), json.dumps(i)) for i in page.items]
    if page.meta:
        out.append(("rdfa", "", json.dumps(page.meta)))
    if page.data:
        out.append(("data", "", json.dumps(page.data)))
    return out


def blobs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, at, source, type, blob of every embedded blob of the pages."""

    return per_page(pages, key, html, "at int, source string, type string, blob string", lambda text: [(i, *b) for i, b in enumerate(read_blobs(text))])
