"""Text found in images: pieces grouped into lines, lines into paragraphs and headings.

A piece is (left, top, right, bottom, text); y grows downwards.
"""

from __future__ import annotations

from statistics import median

Piece = tuple[float, float, float, float, str]
GAP, LEADING, EDGE, HEIGHTS, HEADING, HEADING_CHARS = 2.0, 0.6, 1.0, 0.8, 1.4, 80


def lines(pieces: list[Piece]) -> list[Piece]:
    """Pieces whose middle lies in the height of the row's last piece are a row; within it, gaps of up to twice the height join."""
    rows: list[list[Piece]] = []
    for p in sorted(pieces, key=lambda p: (p[1], p[0])):
        middle = (p[1] + p[3]) / 2
        row = next((r for r in rows if r[-1][1] <= middle <= r[-1][3]), None)
        if row is None:
            rows.append([p])
        else:
            row.append(p)
    out: list[Piece] = []
    for row in rows:
        run: list[Piece] = []
        for p in sorted(row):
            if run and p[0] - run[-1][2] > GAP * (p[3] - p[1]):
                out.append(_joined(run, " "))
                run = []
            run.append(p)
        out.append(_joined(run, " "))
    return out


def _joined(run: list[Piece], sep: str) -> Piece:
    return min(p[0] for p in run), min(p[1] for p in run), max(p[2] for p in run), max(p[3] for p in run), sep.join(p[4] for p in run)


def blocks(pieces: list[Piece]) -> list[tuple[str, str]]:
    """(heading or paragraph, text): lines close below each other with like edges and heights are one paragraph."""
    from fieldspan.operators.statements import is_pair

    found = lines(pieces)
    if not found:
        return []
    usual = median(p[3] - p[1] for p in found)
    out: list[tuple[str, list[Piece]]] = []
    for p in found:
        height = p[3] - p[1]
        if height >= HEADING * usual and len(p[4]) <= HEADING_CHARS:
            out.append(("heading", [p]))
            continue
        if out and out[-1][0] == "paragraph":
            last = out[-1][1][-1]
            tall = last[3] - last[1]
            near = p[1] - last[3] <= LEADING * tall and abs(p[0] - last[0]) <= EDGE * tall and min(height, tall) >= HEIGHTS * max(height, tall)
            if near and not is_pair(p[4]) and not is_pair(last[4]):
                out[-1][1].append(p)
                continue
        out.append(("paragraph", [p]))
    return [(kind, _joined(run, " ")[4]) for kind, run in out]
