"""Learned state: layers, differences, locks, housekeeping, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layered(rows: DataFrame, disables: DataFrame, key: str = "id", layer: str = "layer") -> DataFrame:
    """Of each id the row of the first layer that has it, unless an earlier layer disables it.

    An id that an earlier layer holds hides later ones even where it is itself
    disabled; a layer's disables work on later layers only.
    """
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), layer).alias("row")).select("row.*")
    off = disables.groupBy(key).agg(F.min(layer).alias("off_at"))
    return first.join(off, key, "left").filter(F.col("off_at").isNull() | (F.col("off_at") >= F.col(layer))).drop("off_at")


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change: added, removed or changed."""
    digest = lambda: F.sha2(F.to_json(F.struct(*fields)), 256)
    a, b = old.select(key, digest().alias("was")), new.select(key, digest().alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select(key, change.alias("change"))


def lock(files: DataFrame, key: str, content: Column) -> DataFrame:
    return files.select(key, F.sha2(content, 256).alias("digest"))


def check_lock(locked: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """key, state: changed, missing or extra."""
    joined = locked.select(key, F.col("digest").alias("was")).join(now.select(key, F.col("digest").alias("is")), key, "full_outer")
    state = F.when(F.col("was").isNull(), "extra").when(F.col("is").isNull(), "missing").otherwise("changed")
    return joined.filter(~F.col("was").eqNullSafe(F.col("is"))).select(key, state.alias("state"))


def rates(stats: DataFrame) -> DataFrame:
    """The counters with hit_rate and win_rate, null before any document."""
    rate = lambda c: F.when(F.col("documents") > 0, F.col(c) / F.col("documents"))
    return stats.withColumns({"hit_rate": rate("hits"), "win_rate": rate("wins")})


def housekeeping(stats: DataFrame, prune_after: int = 50, quarantine_after: int = 3) -> DataFrame:
    """The counters with what becomes of the generator: quarantine, prune or keep."""
    verdict = F.when(F.col("failures") >= quarantine_after, "quarantine").when((F.col("documents") >= prune_after) & (F.col("wins") == 0), "prune").otherwise("keep")
    return rates(stats).withColumn("verdict", verdict)


def duplicates(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """id, kept: generators with the same candidates on all examples; most wins stays, the oldest on a tie.

    candidates: id, example, value. A generator without candidates is none's duplicate.
    """
    item = F.sha2(F.concat_ws("\u0000", F.col("example").cast("string"), F.col("value").cast("string")), 256)
    sets = candidates.select("id", item.alias("item")).distinct().groupBy("id").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("shape"))
    best = Window.partitionBy("shape").orderBy(F.desc("wins"), "created", "id")
    found = sets.join(stats.select("id", "wins", "created"), "id").withColumn("kept", F.first("id").over(best))
    return found.filter(F.col("id") != F.col("kept")).select("id", "kept")


def add_counts(stats: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The additive upsert of counters."""
    counters = ["documents", "hits", "wins", "failures"]
    return stats.select(key, *counters).union(new.select(key, *counters)).groupBy(key).agg(*[F.sum(c).alias(c) for c in counters])


def digest_tree(items: DataFrame, key: str, digest: str, levels: int = 3, fan: int = 4096) -> DataFrame:
    """digest: one SHA-256 of all items, as a tree.

    A node is the digest of its children's digests in order of key, newline-joined;
    items of one key // fan are one node, these of one key // fan² the next, and so
    on, with one root above ``levels`` - 1 levels. So no task holds more than fan
    digests, while keys are unique and below fan ** levels.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__key", "__digest"))), lambda s: s["__digest"]), "\n")
    now = items.select(F.col(key).cast("long").alias("__key"), F.col(digest).alias("__digest"))
    for _ in range(levels - 1):
        now = now.groupBy(F.floor(F.col("__key") / fan).alias("__up")).agg(F.sha2(joined, 256).alias("__digest")).select(F.col("__up").alias("__key"), "__digest")
    return now.agg(F.sha2(joined, 256).alias("digest"))
