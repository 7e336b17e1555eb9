"""Key paths of embedded data mapped to the fields of a schema, and their values.

Leaves are rows: doc, blob, fingerprint, ix (place in the blob), path, shape, value.
A mapping row says which field a shape of a fingerprint gives (null: none); layers
of mappings are looked up in order, what no layer knows is asked of a judge, a batch
of paths at a time. All steps are joins and aggregations by (doc, schema, field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.functions.text import estimate_tokens

ACCEPT, UNSURE_TIMES, EXAMPLES, VALUE_CHARS, STATE_TOKENS, MAX_OPTIONS = 0.5, 3, 3, 200, 6000, 255


def known(shapes: DataFrame, mappings: DataFrame) -> DataFrame:
    """The shapes (fingerprint, schema, shape) with field and known: of the first layer that has the shape.

    mappings: layer, fingerprint, schema, shape, field. They are learned state and
    may be large: both sides are shuffled by their keys unless a size is known to be small.
    """
    keys = ["fingerprint", "schema", "shape"]
    first = mappings.groupBy(*keys).agg(F.min_by(F.struct("field"), "layer").alias("m"))
    joined = shapes.join(first, keys, "left")
    return joined.select(*shapes.columns, F.col("m.field").alias("field"), F.col("m").isNotNull().alias("known"))


def questions(leaves: DataFrame, unknown: DataFrame, tokens: int = STATE_TOKENS) -> DataFrame:
    """fingerprint, shape, batch, lines, example: what is asked of unknown shapes, with at most three example values each.

    Shapes of a fingerprint stand in order of their first place; a batch is closed
    before its lines exceed ``tokens``; a shape too large for any batch is left out.
    Only the first rows of a shape are kept, before the shuffle.
    """
    asked = leaves.join(unknown.select("fingerprint", "shape").distinct(), ["fingerprint", "shape"], "left_semi")
    order = Window.partitionBy("fingerprint", "shape").orderBy("doc", "blob", "ix")
    kept = asked.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= EXAMPLES)
    line = F.concat(F.col("path"), F.lit(": "), F.substring("value", 1, VALUE_CHARS))
    listed = F.array_sort(F.collect_list(F.struct("__at", line.alias("line"))))
    shapes = kept.groupBy("fingerprint", "shape").agg(
        F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"),
        F.min(F.when(F.col("__at") == 1, F.substring("value", 1, VALUE_CHARS))).alias("example"),
        F.min("ix").alias("place"),
    )
    sized = shapes.withColumn("tokens", estimate_tokens(F.col("lines"))).filter(F.col("tokens") <= tokens)
    from fieldspan.operators.judge import batches

    numbered = sized.withColumn("place", F.row_number().over(Window.partitionBy("fingerprint").orderBy("place", "shape")).cast("long"))
    placed = batches(numbered.select(F.col("fingerprint").alias("state_id"), "place", "tokens"), tokens)
    return numbered.join(placed.withColumnRenamed("state_id", "fingerprint"), ["fingerprint", "place"]).select("fingerprint", "shape", "batch", "lines", "example")


def accepted(answers: DataFrame, unsure: DataFrame) -> DataFrame:
    """fingerprint, schema, shape, field, sure, times of judged shapes: a likely choice is a mapping, the third unsure one maps to none.

    answers: fingerprint, schema, shape, field ("none" for none), p. unsure: the
    same keys with times, how often an answer was unsure before.
    """
    keys = ["fingerprint", "schema", "shape"]
    joined = answers.join(unsure.select(*keys, "times"), keys, "left")
    sure = F.col("p") >= ACCEPT
    times = F.when(sure, F.lit(0).cast("long")).otherwise(F.coalesce("times", F.lit(0)) + 1)
    field = F.when(sure & (F.col("field") != "none"), F.col("field"))
    return joined.select(*keys, field.alias("field"), (sure | (times >= UNSURE_TIMES)).alias("sure"), times.cast("long").alias("times"))


def field_values(leaves: DataFrame, mapped: DataFrame, read: Column, many: Column) -> DataFrame:
    """doc, schema, field, value, raw, ix: each distinct value that reads, from the first leaf that gives it.

    ``read`` is the value of a leaf's text, null where it can't be read; of a list
    field (``many``) all values are one, comma-joined in order.
    """
    joined = leaves.join(mapped.filter("field IS NOT NULL").select("fingerprint", "schema", "shape", "field"), ["fingerprint", "shape"])
    order = F.struct("blob", "ix")
    valued = joined.withColumns({"__read": read, "__many": many}).filter("__read IS NOT NULL")
    each = valued.groupBy("doc", "schema", "field", F.col("__read").alias("value")).agg(F.min_by("value", order).alias("raw"), F.min(order).alias("__at"), F.first("__many").alias("__many"))
    single = each.filter("NOT __many").select("doc", "schema", "field", "value", "raw", F.col("__at.ix").alias("ix"))
    listed = F.array_sort(F.collect_list(F.struct("__at", "value", "raw")))
    lists = each.filter("__many").groupBy("doc", "schema", "field").agg(listed.alias("l"))
    joined_lists = lists.select("doc", "schema", "field", F.array_join(F.transform("l", lambda x: x["value"]), ",").alias("value"), F.get("l", F.lit(0))["raw"].alias("raw"), F.get("l", F.lit(0))["__at"]["ix"].alias("ix"))
    return single.unionByName(joined_lists)


def disputed(values: DataFrame) -> DataFrame:
    """doc, schema, field, options: fields of several values, as the options of one choice in order; a literal none is quoted.

    Values that read alike once cut are one option. The options of one field of one
    document are one array, of at most 254.
    """
    cut = F.substring("raw", 1, VALUE_CHARS)
    option = F.when(cut == "none", F.lit('"none"')).otherwise(cut)
    each = values.withColumn("option", option).groupBy("doc", "schema", "field", "option").agg(F.min("ix").alias("ix"))
    first = Window.partitionBy("doc", "schema", "field").orderBy("ix", "option")
    kept = each.withColumn("__at", F.row_number().over(first)).filter(F.col("__at") < MAX_OPTIONS)
    listed = F.array_sort(F.collect_list(F.struct("__at", "option")))
    return kept.groupBy("doc", "schema", "field").agg(F.transform(listed, lambda x: x["option"]).alias("options")).filter(F.size("options") > 1)


def settle(values: DataFrame, answers: DataFrame) -> DataFrame:
    """doc, schema, field, value, confidence, alternatives: one value a field; the judge's choice where there are several.

    answers: doc, schema, field, choice, p. "none" leaves the field without a
    value, and all values are alternatives. Without an answer the first value stands.
    """
    keys = ["doc", "schema", "field"]
    cut = F.substring("raw", 1, VALUE_CHARS)
    joined = values.withColumn("option", F.when(cut == "none", F.lit('"none"')).otherwise(cut)).join(answers, keys, "left")
    counts = joined.groupBy(*keys).agg(
        F.count_distinct("option").alias("n"),
        F.min_by("value", "ix").alias("first"),
        F.min_by(F.when(F.col("option") == F.col("choice"), F.col("value")), F.when(F.col("option") == F.col("choice"), F.col("ix"))).alias("picked"),
        F.max("p").alias("p"),
        F.max("choice").alias("choice"),
        F.array_sort(F.collect_set("value")).alias("all"),
    )
    several = (F.col("n") > 1) & F.col("choice").isNotNull()
    value = F.when(several, F.col("picked")).otherwise(F.col("first"))
    others = F.when(several, F.filter("all", lambda v: ~v.eqNullSafe(F.col("picked")))).otherwise(F.array().cast("array<string>"))
    return counts.select(*keys, value.alias("value"), F.when(several, F.col("p")).alias("confidence"), F.array_join(others, "|").alias("alternatives"))


def layout_needed(found: DataFrame, fields: DataFrame, mode: str = "fill_gaps") -> DataFrame:
    """doc, schema, field of what the layout route still has to find after the embedded data.

    fill_gaps: fields without a value; structured_only: all fields of documents in
    which nothing was found; merge: every field. found: doc, schema, field, value;
    fields: doc, schema, field, all that are wanted.
    """
    if mode not in ("fill_gaps", "structured_only", "merge"):
        raise ValueError(f"no mode {mode!r}")
    have = found.filter("value IS NOT NULL")
    if mode == "merge":
        return fields
    keys = ["doc", "schema", "field"] if mode == "fill_gaps" else ["doc", "schema"]
    return fields.join(have.select(*keys).distinct(), keys, "left_anti")


def items(leaves: DataFrame) -> DataFrame:
    """doc, blob, item, path, value: the leaves of each array object, by the innermost indexed prefix of their path."""
    prefix = F.regexp_extract("path", r"^(.*\[\d+\])", 1)
    return leaves.filter(prefix != "").select("doc", "blob", prefix.alias("item"), "path", "value")
