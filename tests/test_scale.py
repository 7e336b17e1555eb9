"""What must not grow with the tables: pieces of batches, joins by a guessed size, tasks of one small file."""

import random

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from fieldspan.operators import embedded, evaluation, html, tables
from fieldspan.operators.evaluate import number, values_match
from fieldspan.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_pages_end_early(spark):
    rows = lambda t: [(i, (t or "none") * 2_000) for i in range(20)]
    schema = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("text", pa.string())])
    batch = pa.RecordBatch.from_pydict({"key": list(range(500)), "said": ["ab"] * 500})
    found = list(html.pieces([batch], 1, schema, rows))
    assert sum(b.num_rows for b in found) == 10_000 and max(b.num_rows for b in found) <= html.PIECE_ROWS
    assert len(found) > 30 and max(sum(map(len, b.column(2).to_pylist())) for b in found) <= html.PIECE_SIGNS + 4_000
    pages = spark.createDataFrame([(i, None if i == 7 else str(i)) for i in range(50)], "key long, said string")
    kept = html.per_page(pages, "key", "said", "at int, text string", rows, keep=("said",))
    assert kept.count() == 1000 and {(x["key"], x["said"], x["text"][:4]) for x in kept.filter("key IN (7, 12) AND at = 3").collect()} == {(7, None, "none"), (12, "12", "1212")}
    assert html.per_page(pages, "key", "said", "at int", lambda t: []).count() == 0


def test_leaves_keep_what_is_wanted_of_their_blob(spark):
    blobs = spark.createDataFrame([(1, "a", '{"x": [1, " "]}'), (1, "b", '{"x": 2}'), (2, "c", "{bad"), (3, "d", None)], "key long, source string, blob string")
    found = embedded.flatten(blobs, "key", keep=("source",))
    assert sorted(map(tuple, found.collect())) == [(1, "a", "$.x[0]", "$.x[]", "1"), (1, "b", "$.x", "$.x", "2")]
    shown = plan(catalogue.QUERIES["embedded_data"](spark, SF))
    assert "Join" not in shown and "RepartitionByExpression" in shown


def cut_pages(spark, folder):
    """Pages with references that lost their semicolon or aren't known, as a column a text is cut in."""
    said = ["Salt &amp;&amp; pepper &amp", "Salt &am", "Salt &", "AT&T &copy 5", "&notit; &amp;lt; &quot;a&quot; x&lt;y"]
    pages = [(i, f"http://a.b/{i}", f'<html lang="en"><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{t} costs 1,204.5.</p></article></body></html>') for i, t in enumerate(said)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def by_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    return sorted(con.execute(catalogue.ORACLE_SQL[name]).fetchall())


def test_incomplete_references_stand_as_in_the_sql(spark, tmp_path):
    folder = cut_pages(spark, tmp_path)
    found = sorted(map(tuple, catalogue.QUERIES["clean_text"](spark, folder).collect()))
    assert found == by_sql("clean_text", folder) and found[0][1].startswith("Salt && pepper &amp\n")
    script = '<script>a && b &amp</script><p title="x&amp&y=1&lt;">&amp'
    node = html.parse(script, strict=True)
    assert [c.text for n in node.walk() for c in n.children if not c.tag] == ["&amp", "a && b &amp"][::-1] and node.children[1].attrs == {"title": "x&amp&y=1<"}
    assert html.parse("a &amp").words() == "a &"


def test_headlines_with_incomplete_references(spark, tmp_path):
    folder = cut_pages(spark, tmp_path)
    found = sorted(tuple(r[c] for c in ("page_id", "headline", "amount", "complete")) for r in catalogue.QUERIES["extract_pages"](spark, folder).collect())
    assert found == by_sql("extract_pages", folder) and found[0][1:] == ("Salt && pepper &amp", 1204.5, True)


def test_records_are_not_broadcast(spark):
    df = catalogue.QUERIES["extract_parts"](spark, SF)
    assert "RepartitionByExpression" in plan(df)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def plain_table(cells):
    """(shape, blank rows) of a table's cells (row, col, row_span, col_span, header, text)."""
    full = [c for c in cells if (c[5] or "").strip()]
    data = {k for c in full if not c[4] for k in range(c[1], c[1] + c[3])}
    blank = set()
    for r in {c[0] for c in full}:
        own = [c for c in full if c[0] == r]
        end = max(c[1] + c[3] for c in own)
        if all(c[4] for c in own) and any(c[0] == r and not c[4] and not (c[5] or "").strip() and c[1] >= end and c[1] in data for c in cells):
            blank.add(r)
    if any(c[4] for c in cells) or not full:
        return None, blank
    width, top = max(c[1] + c[3] for c in full), min(c[0] for c in full)
    letters, digits = (lambda t: sum(map(str.isalpha, t))), (lambda t: sum(map(str.isdecimal, t)))
    if width == 2 and {c[1] for c in full} == {0, 1} and all(c[2] == c[3] == 1 and (c[1] or letters(c[5])) for c in full):
        return "labels", blank
    heads, labels, values = [c for c in full if c[0] == top and c[1]], [c for c in full if c[0] > top and not c[1]], [c for c in full if c[0] > top and c[1]]
    named, told = {k for c in heads for k in range(c[1], c[1] + c[3])}, {k for c in labels for k in range(c[0], c[0] + c[2])}
    numbers = sum(digits(c[5]) > 0 and digits(c[5]) >= letters(c[5]) for c in values)
    good = width >= 3 and values and named == set(range(1, width)) and {c[0] for c in full} - {top} <= told and all(0 < letters(c[5]) >= digits(c[5]) for c in heads) and all(letters(c[5]) for c in labels)
    return ("comparison" if good and 2 * numbers > len(values) else None), blank


def test_shapes_and_blank_rows_of_wide_and_spanning_tables(spark):
    draw, rows, wanted = random.Random(5), [], {}
    for doc in range(600):
        cells, marked, wide = [], draw.random() < 0.5, draw.choice([2, 3, 4, 64, 130])
        for r in range(draw.randint(2, 4)):
            c = 0
            while c < wide:
                across, down = draw.choice([1] * 9 + [2, wide // 2]), draw.choice([1] * 9 + [2])
                likely = "Name" if r == 0 or c == 0 else "150"
                odd = draw.random() < 0.6 / wide
                cells.append((r, c, down, across, marked and (c == 0 or odd), draw.choice(["", " \t", "●", "x 12", None]) if odd or (marked and c and draw.random() < 0.4) else likely))
                c += max(across - (draw.random() < 0.05), 1)
        wanted[doc] = plain_table(cells)
        rows += [(doc, "t", *c) for c in cells]
    df = spark.createDataFrame(rows, "doc int, table string, row int, col int, row_span int, col_span int, header boolean, text string").repartition(5)
    shapes, blank = tables.header_shape(df), tables.blank_rows(df)
    assert {r["doc"]: r["shape"] for r in shapes.collect()} == {d: s for d, (s, _) in wanted.items() if s}
    assert {(r["doc"], r["row"]) for r in blank.collect()} == {(d, r) for d, (_, b) in wanted.items() for r in b}
    assert len({s for s, _ in wanted.values()}) == 3 and any(b for _, b in wanted.values())


def test_tables_are_summed_up_to_rows_before_they_meet(spark):
    for name, scans in (("header_shapes", 2), ("blank_rows", 2), ("row_roles", 2), ("inferred_headers", 6)):
        shown = plan(catalogue.QUERIES[name](spark, SF))
        assert shown.count("Relation") <= scans
        if scans == 2:
            assert "Join" not in shown and shown.rindex("Aggregate [doc#") > shown.rindex("Window [")


def test_pairs_are_made_once(spark):
    for name in ("system_scores", "results_table"):
        shown = plan(catalogue.QUERIES[name](spark, SF))
        assert shown.count("Relation") <= 3 and shown.count("l_orderkey") > 0


def test_scores_from_one_pass(spark):
    draw, kinds = random.Random(4), ["correct", "wrong", "missing", "spurious", "empty"]
    rows = [(draw.choice("ab"), draw.choice([1, 2, 3, 4, None]), "S", draw.choice(["x", "y", None]), draw.choice(["1", None]), draw.choice(kinds)) for _ in range(300)]
    pairs = spark.createDataFrame(rows, "system string, doc int, schema string, entity string, expected string, outcome string")
    runs = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "failed"), ("a", 2, "ok"), ("b", 3, "failed"), ("b", 9, "ok")], "system string, doc int, status string")
    once = {(r["system"], r["doc"]): r for r in evaluation.scored_documents(pairs, runs, ("system",)).collect()}
    records = {(r["system"], r["doc"]): (r["records"], r["complete"]) for r in evaluation.complete_records(pairs, ("system",)).collect()}
    statuses = {("a", 1): ["ok"], ("a", 2): ["failed", "ok"], ("b", 3): ["failed"]}
    for key, r in once.items():
        own = [x for x in rows if (x[0], x[1]) == key]
        final = [(("missing" if x[4] else "empty") if s == "failed" else x[5]) for s in statuses.get(key, ["ok"]) for x in own]
        assert [r[k] for k in kinds] == [final.count(k) for k in kinds] and (r["records"], r["complete"]) == records.get(key, (0, 0))
    apart = evaluation.document_scores(pairs, runs, ("system",)).collect()
    assert {(r["system"], r["doc"], *[r[k] for k in kinds]) for r in apart} == {(*k, *[r[c] for c in kinds]) for k, r in once.items()} and len(once) == 10


def test_texts_that_look_like_numbers(spark):
    said = ["1", " 1.0 ", "1e0", "Infinity", "-inf", "NaN", "nan", "R", "r", " r", "x1", "true", "TRUE", "", None, "1d"]
    found = spark.createDataFrame([(a, b) for a in said for b in said], "a string, b string")
    cast = lambda c: F.col(c).try_cast("double")
    before = values_match(F.col("a"), F.col("b"), numbers=(cast("a"), cast("b")))
    assert found.filter(~before.eqNullSafe(values_match(F.col("a"), F.col("b"))) | ~cast("a").eqNullSafe(number(F.col("a")))).count() == 0
    assert found.filter("a = 'R' AND b = ' r'").filter(values_match(F.col("a"), F.col("b"))).count() == 1
