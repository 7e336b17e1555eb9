"""Entities of a document with several: groups of labels, claims, kinds, ownership, scopes.

Places in a document are paths of component ids, "0.2.1": an ancestor's path with a
dot is a prefix of its descendants'. Every operator is a join or an aggregation by
document and label or table, so that no task holds more than a document's part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPT, KIND, MAX_LABELS = 0.5, 0.7, 254
CONTAINERS = ("section", "list", "list_item", "article")


def words(label: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def ancestors(path: Column) -> Column:
    """The paths above a path, itself included, the outermost first."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def compared(value: Column) -> Column:
    """A cell's text as cells are compared: without case, white space and joiners before letters."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, r"\s+", "")), r"(?<=[\p{L}\p{N}])[-/.'’]+(?=\p{L})", "")


def row_claims(cells: DataFrame) -> DataFrame:
    """doc, table, label, statements: what each row label of a table claims.

    Rows of one label under different bands are one, unless two of them have
    different values under one header: then every label of the table starts with
    its band. cells: doc, table, band, label, header, value, statement.
    """
    conflicts = cells.withColumn("__v", compared(F.col("value"))).groupBy("doc", "table", "label", "header").agg(F.count_distinct("__v").alias("n"), F.count_distinct("band").alias("bands"))
    apart = conflicts.filter("n > 1 AND bands > 1").select("doc", "table").distinct().withColumn("__apart", F.lit(True))
    joined = cells.join(apart, ["doc", "table"], "left")
    label = F.when(F.col("__apart") & F.col("band").isNotNull(), F.concat_ws(" ", "band", "label")).otherwise(F.col("label"))
    return joined.groupBy("doc", "table", label.alias("label")).agg(F.array_sort(F.collect_set("statement")).alias("statements"))


def table_groups(cells: DataFrame, least: int = 2) -> DataFrame:
    """doc, table, axis, label: the column labels of cells with headers on both axes, and the row labels under column headers, of at least ``least`` an axis."""
    columns = cells.filter("header IS NOT NULL AND label IS NOT NULL").select("doc", "table", F.lit("columns").alias("axis"), F.col("header").alias("name"))
    rows = row_claims(cells.filter("header IS NOT NULL AND label IS NOT NULL")).select("doc", "table", F.lit("rows").alias("axis"), F.col("label").alias("name"))
    each = columns.union(rows).distinct()
    enough = each.groupBy("doc", "table", "axis").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return each.join(enough.select("doc", "table", "axis"), ["doc", "table", "axis"], "left_semi").withColumnRenamed("name", "label")


def component_groups(components: DataFrame) -> DataFrame:
    """doc, parent, rule, path, label: runs of same-shaped siblings (rule 1) and headed sections (rule 2), of two or more.

    components: doc, path, parent, type, label (null: none), children (array of
    types), headed (whether the first child is a heading). Headed sections that are
    all one run are that run's only.
    """
    named = components.filter(F.col("label").isNotNull())
    shape = F.concat_ws("/", "type", F.array_join("children", ","))
    boxes = named.filter(F.col("type").isin(*CONTAINERS) & (F.size("children") >= 2)).withColumn("__shape", shape)
    runs = boxes.withColumn("__n", F.count("*").over(Window.partitionBy("doc", "parent", "__shape"))).filter("__n >= 2")
    same = runs.select("doc", "parent", F.lit(1).alias("rule"), "path", "label")
    headed = named.filter("headed")
    # headed sections that one run doesn't hold: several shapes, or some that aren't in any
    shapes = headed.join(runs.select("doc", "parent", "path", "__shape"), ["doc", "parent", "path"], "left")
    told = shapes.groupBy("doc", "parent").agg(F.count("*").alias("n"), F.count_distinct("__shape").alias("shapes"), F.count_if(F.col("__shape").isNull()).alias("loose"))
    wanted = told.filter("n >= 2 AND (loose > 0 OR shapes > 1)").select("doc", "parent")
    return same.union(headed.join(wanted, ["doc", "parent"], "left_semi").select("doc", "parent", F.lit(2).alias("rule"), "path", "label"))


def one_axis(groups: DataFrame, choices: DataFrame) -> DataFrame:
    """The labels of each table's chosen axis (doc, table, axis; none: neither); a group of no table stays.

    A table without a choice, having one accepted axis only, keeps it.
    """
    counts = groups.filter("table IS NOT NULL").groupBy("doc", "table").agg(F.count_distinct("axis").alias("__axes"))
    joined = groups.join(choices.withColumnRenamed("axis", "__choice"), ["doc", "table"], "left").join(counts, ["doc", "table"], "left")
    kept = F.col("table").isNull() | F.when(F.col("__choice").isNotNull(), F.col("axis") == F.col("__choice")).otherwise(F.col("__axes") == 1)
    return joined.filter(kept).select(*groups.columns)


def unified(entities: DataFrame) -> DataFrame:
    """doc, entity, unit, over: entities of one label that state no different things are one unit.

    entities: doc, entity, label, values (map of header to value). Those that differ
    from another are placed first; one that fits several different units stays a
    unit of its own, ``over`` each of them (the units it is coarser than, comma-joined).
    """

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        own = [(r.entity, dict(r["values"] or {})) for _, r in rows.sort_values("entity").iterrows()]
        conflict = lambda a, b: any(k in b and b[k] != v for k, v in a.items())
        apart = [e for e in own if any(conflict(e[1], o[1]) for o in own)]
        units: list[tuple[str, dict]] = []
        over: list[tuple[str, dict, set]] = []
        out = {}
        for name, stated in [*apart, *(e for e in own if e not in apart)]:
            fits = [u for u in units if not conflict(u[1], stated)]
            if len(fits) == 1:
                fits[0][1].update({**stated, **fits[0][1]})
                out[name] = fits[0][0]
            elif not fits:
                units.append((name, dict(stated)))
                out[name] = name
            else:
                held = next((o for o in over if not conflict(o[1], stated)), None)
                if held is None:
                    over.append(held := (name, dict(stated), set()))
                held[1].update({**stated, **held[1]})
                held[2].update(u[0] for u in fits)
                out[name] = held[0]
        finer = {o[0]: ",".join(sorted(o[2])) for o in over}
        return pd.DataFrame([(rows["doc"].iloc[0], e, u, finer.get(u, "")) for e, u in out.items()], columns=["doc", "entity", "unit", "over"])

    kind = dict(entities.dtypes)["doc"]
    return entities.groupBy("doc", "label").applyInPandas(place, f"doc {kind}, entity string, unit string, over string")


def relations(picks: DataFrame) -> DataFrame:
    """doc, finer, coarser, or both as one (same), from which label an entity was said to be a kind of.

    picks: doc, entity, picked (labels), p, conflict (whether their values differ),
    entity_apart and picked_apart (whether each differs from other pickers).
    """
    sure = picks.filter((F.col("p") >= KIND) & ~F.col("conflict"))
    back = sure.select("doc", F.col("picked").alias("entity"), F.col("entity").alias("picked"), F.lit(True).alias("back"))
    count = sure.groupBy("doc", F.col("picked").alias("__of")).agg(F.count("*").alias("n"))
    joined = sure.join(back, ["doc", "entity", "picked"], "left")
    joined = joined.join(count.select("doc", F.col("__of").alias("picked"), F.col("n").alias("of_n")), ["doc", "picked"], "left").join(count.select("doc", F.col("__of").alias("entity"), F.col("n").alias("own_n")), ["doc", "entity"], "left")
    a, b = words(F.col("entity")), words(F.col("picked"))
    inside, around = (F.size(F.array_except(a, b)) == 0), (F.size(F.array_except(b, a)) == 0)
    mine, theirs = F.col("entity_apart"), F.col("picked_apart")
    own = F.coalesce("own_n", F.lit(0))
    how = (
        F.when(inside & around, F.when(mine & ~theirs, "kind").when(theirs & ~mine, "over").when(~mine, "same"))
        .when(inside, "over")
        .when(around | F.col("back").isNull(), "kind")
        .when(F.col("of_n") > own, "kind")
        .when(F.col("of_n") == own, "same")
    )
    told = joined.withColumn("how", how).filter("how IS NOT NULL")
    turned = F.col("how") == "over"
    low, high = F.least("entity", "picked"), F.greatest("entity", "picked")
    same = F.col("how") == "same"
    first = F.when(same, low).when(turned, F.col("picked")).otherwise(F.col("entity"))
    second = F.when(same, high).when(turned, F.col("entity")).otherwise(F.col("picked"))
    return told.select("doc", first.alias("finer"), second.alias("coarser"), same.alias("same")).distinct()


def owners(statements: DataFrame, groups: DataFrame) -> DataFrame:
    """doc, statement, label: the labels of the first group that claims a statement, the deepest, then by rule.

    groups: doc, group, depth, rule, label, statements (array).
    """
    claims = groups.select("doc", "group", "depth", "rule", "label", F.explode("statements").alias("statement"))
    first = claims.groupBy("doc", "statement").agg(F.min(F.struct(-F.col("depth"), F.col("rule"), F.col("group"))).alias("f"))
    kept = claims.join(first, ["doc", "statement"]).filter(F.col("group") == F.col("f.group"))
    return kept.join(statements.select("doc", "statement"), ["doc", "statement"], "left_semi").select("doc", "statement", "label")


def finest(owned: DataFrame, kinds: DataFrame, statements: DataFrame) -> DataFrame:
    """doc, label of the records: they own more than headings and headers, and no other such is a kind of them.

    kinds: doc, finer, coarser, closed under transitivity.
    """
    solid = owned.join(statements.filter(~F.col("kind").isin("heading", "table_header")).select("doc", "statement"), ["doc", "statement"], "left_semi").select("doc", "label").distinct()
    below = kinds.join(solid.withColumnRenamed("label", "finer"), ["doc", "finer"], "left_semi").select("doc", F.col("coarser").alias("label"))
    return solid.join(below, ["doc", "label"], "left_anti")


def assigned(loose: DataFrame, records: DataFrame, answers: DataFrame) -> DataFrame:
    """doc, statement, label, shared: an unclaimed statement goes to the records of the nearest part above it that has any.

    loose: doc, statement, path, kind; records: doc, label, path; answers: doc,
    statement, choice ("all" or none: shared by all). A heading, a header or a
    single record needs no answer and is shared.
    """
    parts = records.select("doc", "label", F.explode(ancestors(F.col("path"))).alias("part")).distinct()
    held = parts.select("doc", "part").distinct()
    above = loose.select("doc", "statement", "kind", F.posexplode(ancestors(F.col("path"))).alias("depth", "part"))
    nearest = above.join(held, ["doc", "part"]).groupBy("doc", "statement", "kind").agg(F.max_by("part", "depth").alias("part"))
    offered = nearest.join(parts, ["doc", "part"]).withColumn("n", F.count("*").over(Window.partitionBy("doc", "statement")))
    told = offered.join(answers.select("doc", "statement", "choice"), ["doc", "statement"], "left")
    shared = F.col("kind").isin("heading", "table_header") | (F.col("n") == 1) | F.col("choice").isNull() | (F.col("choice") == "all")
    return told.filter(shared | (F.col("label") == F.col("choice"))).select("doc", "statement", "label", shared.alias("shared"))


def named_elsewhere(labels: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """doc, label, other: labels of other tables with a label's words, or those and more or fewer; one without letters names nothing.

    Labels meet by a shared word of their document, not in pairs.
    """
    split = lambda df, name, alias: df.select("doc", F.col("table").alias(f"{alias}_table"), F.col("label").alias(name), words(F.col("label")).alias(f"{alias}_words"))
    mine = split(labels.filter(F.col("label").rlike(r"\p{L}")), "label", "own")
    theirs = split(elsewhere, "other", "other")
    met = mine.withColumn("word", F.explode("own_words")).join(theirs.withColumn("word", F.explode("other_words")), ["doc", "word"]).filter("own_table <> other_table")
    fits = (F.size(F.array_except("own_words", "other_words")) == 0) | (F.size(F.array_except("other_words", "own_words")) == 0)
    return met.filter(fits).select("doc", "label", "other").distinct()


def type_members(components: DataFrame, kind: str) -> DataFrame:
    """doc, path, label of the outermost components of a type."""
    own = components.filter(F.col("type") == kind)
    above = own.select("doc", "path", F.explode(F.slice(ancestors(F.col("path")), F.lit(1), F.size(ancestors(F.col("path"))) - 1)).alias("up"))
    inner = above.join(own.select("doc", F.col("path").alias("up")), ["doc", "up"], "left_semi").select("doc", "path").distinct()
    return own.join(inner, ["doc", "path"], "left_anti").select("doc", "path", "label")


def placed_values(objects: DataFrame, labels: DataFrame, answers: DataFrame) -> DataFrame:
    """doc, label, path, shared: embedded objects go to the entity chosen, all others to every entity as shared.

    objects: doc, path; labels: doc, label; answers: doc, path, choice. An object
    that holds another placed one isn't placed, nor is any in a document of more
    than 254 labels.
    """
    counts = labels.groupBy("doc").agg(F.count("*").alias("n"))
    few = counts.filter(F.col("n") <= MAX_LABELS).select("doc")
    placed = objects.join(answers, ["doc", "path"]).join(labels.select("doc", F.col("label").alias("choice")), ["doc", "choice"], "left_semi").join(few, "doc", "left_semi")
    above = placed.select("doc", F.explode(F.filter(ancestors(F.col("path")), lambda p: p != F.col("path"))).alias("path")).distinct()
    own = placed.join(above, ["doc", "path"], "left_anti").select("doc", F.col("choice").alias("label"), "path", F.lit(False).alias("shared"))
    rest = objects.join(own.select("doc", "path"), ["doc", "path"], "left_anti").join(labels.select("doc", "label"), "doc").select("doc", "label", "path", F.lit(True).alias("shared"))
    return own.union(rest)


def unassigned(statements: DataFrame, scopes: DataFrame) -> DataFrame:
    """The statements that no scope of their document has."""
    return statements.join(scopes.select("doc", "statement").distinct(), ["doc", "statement"], "left_anti")


def closed(kinds: DataFrame) -> DataFrame:
    """doc, finer, coarser under transitivity; a document's relations are few, and go to one group."""

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        up: dict[str, set[str]] = {}
        for a, b in zip(rows["finer"], rows["coarser"]):
            up.setdefault(a, set()).add(b)

        def reach(at: str) -> Iterator[str]:
            seen, waiting = set(), [at]
            while waiting:
                for b in up.get(waiting.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        waiting.append(b)
            return iter(seen - {at})

        return pd.DataFrame([(rows["doc"].iloc[0], a, b) for a in up for b in sorted(reach(a))], columns=["doc", "finer", "coarser"])

    kind = dict(kinds.dtypes)["doc"]
    return kinds.groupBy("doc").applyInPandas(close, f"doc {kind}, finer string, coarser string")
