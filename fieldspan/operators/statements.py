"""Statements: atomic texts of a document with their kind, trail and place; gate units."""

from __future__ import annotations

import re
from collections.abc import Iterator

from fieldspan.operators.html import Component, Node, components, parse, trail_text

CUT, SEGMENT, UNIT = 4000, 3000, 2000
ABBREVIATIONS = {
    "en": {"mr", "mrs", "ms", "dr", "prof", "st", "no", "vs", "etc", "inc", "ltd", "e.g", "i.e", "approx", "fig", "vol"},
    "de": {"z.b", "d.h", "u.a", "bzw", "ca", "nr", "dr", "prof", "str", "usw", "evtl", "inkl"},
    "fr": {"m", "mme", "dr", "etc", "p.ex", "env", "av", "bd"},
    "es": {"sr", "sra", "dr", "dra", "etc", "p.ej", "aprox", "núm"},
}
_END = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+(?=\S)")


def sentences(text: str, language: str = "en") -> list[str]:
    """The sentences of a line; a split after an abbreviation, an initial or before a small letter is undone."""
    short = ABBREVIATIONS.get(language, set()) | ABBREVIATIONS["en"]
    out: list[str] = []
    for part in (p for chunk in chunks(text) for p in _END.split(chunk)):
        part = part.strip()
        if not part:
            continue
        if out:
            last = out[-1].rsplit(None, 1)[-1].rstrip(".").lower()
            ended = out[-1][-1]
            if ended == "." and (last in short or (len(last) == 1 and last.isalpha()) or (part[0].islower())):
                out[-1] += " " + part
                continue
        out.append(part)
    return out


def chunks(text: str, most: int = SEGMENT) -> list[str]:
    """Longer lines cut at the last clear boundary before ``most`` characters."""
    out = []
    while len(text) > most:
        at = max(text.rfind(s, 0, most) + len(s) for s in (". ", "; ", ", ", " "))
        at = at if at > most // 2 else most
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


_LABEL = re.compile(r"^\s*([^:\n]{1,60}?)\s*:(?=\s|$)\s*(.+)$", re.S)


def is_pair(text: str) -> bool:
    """Whether the text is one `Label: value`."""
    m = _LABEL.match(text)
    return bool(m) and len(m.group(1).split()) <= 8 and any(c.isalpha() for c in m.group(1)) and "://" not in text


Cell = tuple[int, int, int, int, bool, str]


def roles(cells: list[Cell]) -> dict[int, str]:
    """band, header or body for each row with text, as ``tables.row_roles`` says it of a relation."""
    full = [c for c in cells if c[5].strip()]
    out = {c[0]: "body" for c in full}
    if len({c[4] for c in full}) < 2:
        return out
    width, top = max(c[1] + c[3] for c in full), min(out)
    naming = any(c[4] and c[0] == top and c[1] for c in full)
    body, heads, stop, columns = set(), {}, {}, set()
    for row, at, down, across, header, words in full:
        stop[row] = max(stop.get(row, 0), at + across)
        heads[row] = heads.get(row, True) and header
        if not header:
            columns.update(range(at, at + across))
            if row != top or not naming or any(map(str.isalnum, words)):
                body.update(range(row, row + down))
    body.update(row for row, at, _, _, header, words in cells if not header and not words.strip() and heads.get(row) and at >= stop[row] and at in columns)
    for row in out:
        own = [c for c in full if c[0] == row]
        if row not in body and any(c[4] for c in own):
            out[row] = "band" if len(own) == 1 and own[0][4] and not own[0][1] and width > 1 else "header"
    return out


def table_statements(cells: list[Cell]) -> Iterator[tuple[str, str]]:
    """(kind, text): `band › row · column: value` for every value cell, and the headers.

    Header rows stack while no body row came between, else they replace those above;
    a band prefixes the rows below it up to the next one; the first header of a body
    row, or its first cell under column headers, is the row's name, and goes with
    every row that it spans.
    """
    role = roles(cells)
    by_row: dict[int, list[Cell]] = {}
    for cell in sorted(cells):
        if cell[5].strip():
            for row in range(cell[0], cell[0] + (cell[2] if cell[4] and not cell[1] else 1)):
                by_row.setdefault(row, []).append(cell)
    mixed = len({c[4] for c in cells if c[5].strip()}) == 2
    columns: dict[int, list[str]] = {}
    band, last = "", ""
    for number in sorted(by_row):
        row, kind = sorted(by_row[number], key=lambda c: c[1]), role.get(number, "body")
        if kind == "band":
            band = row[0][5]
        elif kind == "header":
            if last == "body":
                columns = {}
            for _, at, _, across, _, words in row:
                for i in range(at, at + across):
                    if words not in columns.setdefault(i, []):
                        columns[i].append(words)
            yield from (("table_header", c[5]) for c in row)
        else:
            last = kind
            if mixed and all(c[4] for c in row):
                continue  # labels without a value of their own
            named = len(row) > 1 and (row[0][4] or (bool(columns) and row[0][1] == 0))
            label = row[0][5] if named else ""
            for _, at, _, _, _, words in row[1 if named else 0 :]:
                name = " › ".join(x for x in (band, label) if x)
                prefix = " · ".join(x for x in (name, " ".join(columns.get(at, []))) if x)
                yield "table_cell", f"{prefix}: {words}" if prefix else words
        last = kind


def statements(markup: str | None, language: str = "en") -> list[tuple[int, str, str, str, str]]:
    """(place, component type, kind, trail, text) of every statement of a page, in order."""
    return statements_of(parse(markup), language)


def statements_of(root: Node, language: str = "en") -> list[tuple[int, str, str, str, str]]:
    """The statements of a parsed page."""
    out: list[tuple[int, str, str, str, str]] = []
    trail: list[tuple[int, str]] = []
    for c in components(root):
        if c.type == "heading":
            trail = [(r, t) for r, t in trail if r < c.rank]
            found = [("heading", c.text)]
        elif c.type == "table":
            found = list(table_statements(c.cells))
        elif c.type == "image":
            found = [("caption", c.text)] if c.text else []
        elif c.type == "list_item":
            found = [("key_value" if is_pair(c.text) else "list_item", c.text)]
        else:
            found = [("key_value", line) if is_pair(line) else ("sentence", s) for line in c.text.split("\n") for s in ([line] if is_pair(line) else sentences(line, language))]
        section = trail_text([t for _, t in trail])
        for kind, text in found:
            for piece in cut(text):
                out.append((len(out), c.type, kind, section, piece))
        if c.type == "heading":
            trail.append((c.rank, c.text))
    return out


def cut(text: str, most: int = CUT) -> list[str]:
    """Longer statements cut at a sentence end or space."""
    return [p.strip() for p in chunks(text, most) if p.strip()]


def lines_of(c: Component) -> tuple[list[str], list[str]]:
    """(context to repeat, lines) of a component as a gate reads it."""
    if c.type != "table":
        return [], [c.text] if c.text else []
    rows: dict[int, list[str]] = {}
    heads: set[int] = set()
    for r, _, _, _, header, words in c.cells:
        rows.setdefault(r, []).append(words)
    for r in sorted(rows):
        if all(h for rr, _, _, _, h, w in c.cells if rr == r and w):
            heads.add(r)
        else:
            break
    text = {r: " | ".join(w for w in own if w) for r, own in rows.items()}
    return [text[r] for r in sorted(heads)], [text[r] for r in sorted(rows) if r not in heads and text[r]]


def windows(text: str, most: int = UNIT) -> list[str]:
    """Overlapping windows of a long text; the overlap is min(200, most / 10)."""
    step = most - min(200, most // 10)
    return [text[i : i + most] for i in range(0, max(len(text) - (most - step), 1), step)]


def gate_units(markup: str | None, most: int = UNIT) -> list[tuple[int, str, str]]:
    """(place, section, text) of units of at most ``most`` characters: lines packed greedily, headings lead, tables repeat their headers."""
    out: list[tuple[int, str, str]] = []
    trail: list[tuple[int, str]] = []
    held: list[str] = []
    section = ""

    def flush(lead: list[str] | None = None) -> None:
        if held:
            out.append((len(out), section, "\n".join([*(lead or []), *held])))
            held.clear()

    for c in components(parse(markup)):
        if c.type == "heading":
            flush()
            trail = [(r, t) for r, t in trail if r < c.rank] + [(c.rank, c.text)]
            section = trail_text([t for _, t in trail])
            continue
        context, lines = lines_of(c)
        if context:
            flush()
        room = most - sum(len(x) + 1 for x in context)
        for line in (w for x in lines for w in (windows(x, max(room, 1)) if len(x) > room else [x])):
            if held and sum(len(x) + 1 for x in held) + len(line) > room:
                flush(context)
            held.append(line)
        if context:
            flush(context)
    flush()
    return out
