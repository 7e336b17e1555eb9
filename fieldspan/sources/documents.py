"""Documents from files, results and inputs as JSON lines, packs as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.functions.text import sniff_content_type, source, type_of_path

RESULT = "path string, records map<string,string>, seconds double, calls long, input_tokens long, output_tokens long, cost double, model string, error string, methods map<string,long>"


def from_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, content_type, url, source of files; the type by content, else by extension."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    kind = F.coalesce(sniff_content_type(F.col("content")), type_of_path(F.col("path")))
    url = F.lit(None).cast("string")
    return files.select("path", "content", kind.alias("content_type"), url.alias("url"), source(F.lit(None).cast("string"), url).alias("source"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, schema, wave, locale, entity, values of a labelled corpus's truth.json."""
    shape = "pages array<struct<path:string,schema:string,wave:int,locale:string,records:array<struct<entity:string,values:map<string,string>>>>>"
    pages = spark.read.schema(shape).option("multiLine", True).json(f"{path}/truth.json").select(F.explode("pages").alias("p")).select("p.*")
    return pages.select("path", "schema", "wave", "locale", F.explode_outer("records").alias("r")).select("path", "schema", "wave", "locale", "r.entity", "r.values")


def write_inputs(prepared: DataFrame, out: str) -> None:
    """Prepared texts as JSON lines: path, text."""
    prepared.select("path", "text").write.mode("overwrite").json(out)


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, text string").option("mode", "FAILFAST").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document; a malformed line is an error."""
    return spark.read.schema(RESULT).option("mode", "FAILFAST").json(path)


def write_curve(points: DataFrame, out: str) -> None:
    points.write.mode("overwrite").option("header", True).csv(out)


def read_curve(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A learning curve from CSV: the required columns must be there, empty fields are null."""
    found = spark.read.option("header", True).option("nullValue", "").csv(path)
    if missing := [c for c in required if c not in found.columns]:
        raise ValueError(f"the file has no column {', '.join(missing)}")
    return found


def write_pack(tables: dict[str, DataFrame], out: str) -> None:
    """A pack of learned rows: a Parquet folder for each table, in order of its first column."""
    for name, df in sorted(tables.items()):
        df.repartitionByRange(1, df.columns[0]).sortWithinPartitions(*df.columns[:1]).write.mode("overwrite").parquet(f"{out}/{name}")


def read_pack(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
