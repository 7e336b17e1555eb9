"""Sentences, gate units and page statements against plain versions, over every row of the given tables."""

import re

import pytest

from fieldspan.operators import html, statements
from fieldspan.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain_sentences(line):
    """The sentences of a line of at most 3,000 signs, sign by sign."""
    cuts, i = [], 0
    while i < len(line):
        if line[i] in ".!?…":
            j = i + 1
            while j < len(line) and line[j] in "\"'”»)":
                j += 1
            k = j
            while k < len(line) and line[k].isspace():
                k += 1
            if k > j and k < len(line):
                cuts.append((i + 1, k))
                i = k
                continue
        i += 1
    parts, at = [], 0
    for end, start in [*cuts, (len(line), len(line))]:
        parts.append(line[at:end].strip())
        at = start
    out = []
    for part in filter(None, parts):
        last = re.split(r"\s+", out[-1])[-1].rstrip(".").lower() if out else ""
        joined = out and out[-1].endswith(".") and (last in statements.ABBREVIATIONS["en"] or (len(last) == 1 and last.isalpha()) or part[0].islower())
        if joined:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def test_sentences(spark):
    found = {}
    for r in catalogue.QUERIES["sentences"](spark, SF).collect():
        found.setdefault(r["doc_id"], []).append((r["at"], r["sentence"]))
    checked = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        lines = (r["text"] or "").split("\n")
        if max(map(len, lines)) > statements.SEGMENT:
            assert "".join("".join(s.split()) for _, s in sorted(found[r["doc_id"]])) != ""
            continue
        checked += 1
        assert [s for _, s in sorted(found.get(r["doc_id"], []))] == [s for line in lines for s in plain_sentences(line)]
    assert checked > 100


@pytest.mark.parametrize("most", [200, 2000])
def test_gate_units_hold_every_line_once(spark, most):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        parts = html.components(html.parse(r["html"]))
        units = statements.gate_units(r["html"], most)
        assert [at for at, _, _ in units] == list(range(len(units))) and all(len(u) <= most for _, _, u in units)
        said = "\n".join(u for _, _, u in units)
        for c in parts:
            if c.type in ("paragraph", "list_item") and c.text and len(c.text) <= most:
                assert c.text in said
        trails, trail = set(), []
        for c in parts:
            if c.type == "heading":
                trail = [(k, t) for k, t in trail if k < c.rank] + [(c.rank, c.text)]
            trails.add(html.trail_text([t for _, t in trail]))
        assert {s for _, s, _ in units} <= trails


def test_page_statements_hold_the_page(spark):
    found = {}
    for r in catalogue.QUERIES["page_statements"](spark, SF).collect():
        found.setdefault(r["page_id"], []).append(r)
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        own = sorted(found.get(r["page_id"], []), key=lambda s: s["at"])
        assert [s["at"] for s in own] == list(range(len(own)))
        parts = html.components(html.parse(r["html"]))
        heads = [c.text for c in parts if c.type == "heading"]
        assert [s["said"] for s in own if s["kind"] == "heading"] == heads
        # every sign of the paragraphs and items stands in the statements, in order; quotes before a cut go
        squeeze = lambda t: re.sub(r"[\s\"'”»)]+", "", t)
        assert "".join(squeeze(s["said"]) for s in own if s["component"] in ("paragraph", "list_item")) == "".join(squeeze(c.text) for c in parts if c.type in ("paragraph", "list_item"))
