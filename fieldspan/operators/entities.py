"""Entities: statements of a document grouped into records.

A resolver gives scopes: (doc, entity, statement, own). Single: the document is one
entity. Children: one entity for each row, column or component of a declared kind.
Multi: labels from table axes and headings that name at least two siblings, or the
whole document when there are none; statements outside every label are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def single(statements: DataFrame, label: str = "document") -> DataFrame:
    return statements.select("doc", F.lit(label).alias("entity"), "statement", F.lit(True).alias("own"))


def by_axis(statements: DataFrame) -> DataFrame:
    """Scopes from axis labels: statements with a label are its own, others are shared by all labels of the document.

    statements: doc, statement, label (null: none). Labels of one document that
    repeat at different places are numbered by ``unique_labels`` beforehand.
    """
    labels = statements.filter(F.col("label").isNotNull()).select("doc", F.col("label").alias("entity")).distinct()
    counts = labels.groupBy("doc").agg(F.count("*").alias("n"))
    several = labels.join(counts.filter("n >= 2").select("doc"), "doc", "left_semi")
    own = statements.join(several.select("doc", F.col("entity").alias("label")), ["doc", "label"]).select("doc", F.col("label").alias("entity"), "statement", F.lit(True).alias("own"))
    loose = statements.filter(F.col("label").isNull()).join(several, "doc").select("doc", "entity", "statement", F.lit(False).alias("own"))
    alone = statements.join(several.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit("document").alias("entity"), "statement", F.lit(True).alias("own"))
    return own.unionByName(loose).unionByName(alone)


def unique_labels(labels: DataFrame) -> DataFrame:
    """doc, place, entity: labels that repeat in a document are numbered `X (2)` in order of place."""
    order = Window.partitionBy("doc", "label").orderBy("place")
    numbered = labels.withColumn("__n", F.row_number().over(order))
    return numbered.select("doc", "place", F.when(F.col("__n") == 1, F.col("label")).otherwise(F.concat(F.col("label"), F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))).alias("entity"))


def name_apart(records: DataFrame) -> DataFrame:
    """Entities of one label in different sections are prefixed by their section."""
    same = Window.partitionBy("doc", "entity")
    return records.withColumn("entity", F.when(F.count("*").over(same) > 1, F.concat_ws(" › ", "section", "entity")).otherwise(F.col("entity")))


def conflicts(claims: DataFrame) -> DataFrame:
    """doc, label where one label has different values under one header: it names different entities."""
    return claims.groupBy("doc", "label", "header").agg(F.count_distinct("value").alias("n")).filter("n > 1").select("doc", "label").distinct()


def check_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children without a parent of their name: none is allowed."""
    return children.join(parents.select("doc", F.col("entity").alias("parent")), ["doc", "parent"], "left_anti")
