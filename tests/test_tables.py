"""Roles of rows against a plain version over random tables with spans, empty cells and symbols."""

import random

from fieldspan.operators import tables


def plain_roles(cells):
    full = [c for c in cells if c[6].strip()]
    roles = {c[0]: "body" for c in full}
    if not full or all(c[4] for c in full) or not any(c[4] for c in full):
        return roles
    width, top = max(c[1] + c[3] for c in full), min(c[0] for c in full)
    named = any(c[4] and c[0] == top and c[1] > 0 for c in full)
    data = {r for c in full if not c[4] and (c[0] != top or not named or any(x.isalnum() for x in c[6])) for r in range(c[0], c[0] + c[2])}
    columns = {k for c in full if not c[4] for k in range(c[1], c[1] + c[3])}
    end = {}
    for c in full:
        end[c[0]] = max(end.get(c[0], 0), c[1] + c[3])
    heads = set(end) - {c[0] for c in full if not c[4]}
    data |= {c[0] for c in cells if c[0] in heads and not c[4] and not c[6].strip() and c[1] >= end[c[0]] and c[1] in columns}
    for r in roles:
        row = [c for c in full if c[0] == r]
        if r not in data and any(c[4] for c in row):
            roles[r] = "band" if len(row) == 1 and row[0][4] and row[0][1] == 0 and width > 1 else "header"
    return roles


def test_row_roles(spark):
    draw, rows, wanted = random.Random(3), [], {}
    for doc in range(400):
        cells = []
        for r in range(draw.randint(1, 5)):
            c = 0
            while c < 4:
                across = draw.choice([1, 1, 1, 2])
                header = draw.random() < (0.8 if r == 0 or c == 0 else 0.15)
                cells.append((r, c, draw.choice([1, 1, 1, 2]), across, header, None, draw.choice(["", " ", "●", "£", "Name", "150", "x y", "Power"])))
                c += across + draw.choice([0, 0, 1])
        wanted[doc] = plain_roles(cells)
        rows += [(doc, "t", r, c, down, across, header, text) for r, c, down, across, header, _, text in cells]
    df = spark.createDataFrame(rows, "doc int, table string, row int, col int, row_span int, col_span int, header boolean, text string").repartition(5)
    found = {}
    for x in tables.row_roles(df).collect():
        found.setdefault(x["doc"], {})[x["row"]] = x["role"]
    assert found == {k: v for k, v in wanted.items() if v}
    assert {r for v in wanted.values() for r in v.values()} == {"band", "header", "body"}
    assert tables.row_roles(df.limit(0)).count() == 0 and tables.header_shape(df.limit(0)).count() == 0


def test_statements_of_tables():
    from fieldspan.operators.statements import roles, table_statements

    head = [(0, 0, 1, 1, True, ""), (0, 1, 1, 1, True, "Small"), (0, 2, 1, 1, True, "Large")]
    body = [(1, 0, 1, 3, True, "Engine"), (2, 0, 1, 1, True, "Power"), (2, 1, 1, 1, False, "50"), (2, 2, 1, 1, False, "70"), (3, 0, 1, 1, True, "Tow"), (3, 1, 1, 1, False, ""), (3, 2, 1, 1, False, "")]
    again = [(4, 1, 1, 1, True, "Old"), (5, 0, 2, 1, True, "Mass"), (5, 1, 1, 1, False, "9"), (6, 1, 1, 1, False, "8")]
    assert roles(head + body + again) == {0: "header", 1: "band", 2: "body", 3: "body", 4: "header", 5: "body", 6: "body"}
    said = [t for k, t in table_statements(head + body + again) if k == "table_cell"]
    assert said == ["Engine › Power · Small: 50", "Engine › Power · Large: 70", "Engine › Mass · Old: 9", "Engine › Mass · Old: 8"]


def test_roles_agree_with_the_relation():
    from fieldspan.operators.statements import roles

    draw = random.Random(8)
    for _ in range(3000):
        cells = [(r, c, draw.choice([1, 1, 2]), 1, draw.random() < 0.5, draw.choice(["", "●", "Name", "150"])) for r in range(draw.randint(1, 4)) for c in range(3)]
        assert roles(cells) == plain_roles([(*c[:5], None, c[5]) for c in cells])
