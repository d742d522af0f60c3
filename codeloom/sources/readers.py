"""Sources: JSON lines, whole JSON documents, task files of either shape, registries, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.storage import stored
from codeloom.operators.sampling import hash_order_sample

RAW_SFT = "instruction string, output string, tag string"
SFT = "instruction string, input string, output string"
RAW_RATED = "instruction string, responses array<struct<model:string,response:string>>, annotations array<struct<model:string,rating:string>>"
PAIR = "prompt string, chosen string, rejected string, source string"
TASK = "task_id string, prompt string, canonical_solution string, test string, entry_point string, instruction string, question string"
CASE = "task_id string, entry_point string, pass_at_1 boolean, pass_at_k boolean, candidate_results array<boolean>, candidate_samples array<string>"
ENTRY = "file_name string, ranking boolean, columns map<string,string>"


def numbered(df: DataFrame, name: str = "idx", *, files: bool = False) -> DataFrame:
    """Rows numbered from 0, gapless, without one task seeing all rows: only the sizes of runs meet on the way.

    ``files``: in the order of file names and places in them, for rows straight from files (their partitions follow
    sizes, not names); else in the order of partitions.
    """
    if files:
        run = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    else:
        run = [F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_block")]
    rows = stored(df.select(*df.columns, *run, F.monotonically_increasing_id().alias("_row")), "numbered")
    sizes = rows.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("_file", "_block", (before - F.col("first")).alias("shift"))
    return rows.join(base, ["_file", "_block"]).select((F.col("_row") + F.col("shift")).alias(name), *df.columns)


def json_lines(spark: SparkSession, path: str, schema: str, *, idx: bool = True) -> DataFrame:
    """Blank lines are no rows; a malformed line fails the job; all files are read in the order of their names."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return numbered(rows, files=True) if idx else rows


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of records, or one record, in each file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def first_record(df: DataFrame, idx: str = "idx") -> DataFrame:
    return df.orderBy(idx).limit(1)


def task_file(spark: SparkSession, path: str, schema: str = TASK) -> DataFrame:
    """Tasks of a file that is a list of records, or a map from id to record; a malformed file fails the job."""
    whole = spark.read.text(path, wholetext=True)
    record, strict = T._parse_datatype_string(schema), {"mode": "FAILFAST"}
    is_list = F.col("value").rlike(r"\A\s*\[")
    listed = whole.where(is_list).select(F.explode(F.from_json("value", T.ArrayType(record), strict)).alias("r")).select("r.*")
    keyed = whole.where(~is_list).select(F.explode(F.from_json("value", T.MapType(T.StringType(), record), strict)).alias("key", "r"))
    rest = [f"r.{c}" for c in record.fieldNames() if c != "task_id"]
    return listed.unionByName(keyed.select(F.coalesce("r.task_id", "key").alias("task_id"), *rest))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """name, file_name, ranking, columns of a registry file; a malformed file fails the job."""
    whole = spark.read.text(path, wholetext=True)
    entry = T._parse_datatype_string(ENTRY)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), entry), {"mode": "FAILFAST"})).alias("name", "e")).select("name", "e.*")


def hub_copy(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A local copy of a published dataset; nothing is fetched."""
    return spark.read.format(format).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def subset_or_sample(spark: SparkSession, subset: str, full: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first n tasks of the subset file if there is one, else n of the full set in seeded order."""
    if exists(spark, subset):
        return first_n(numbered(task_file(spark, subset)), n)
    return hash_order_sample(full, n, seed, "task_id")


def first_n(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("idx").limit(n).drop("idx")


def last_match(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """value: the last line of the logs that matches."""
    lines = numbered(spark.read.text(path), files=True).where(F.col("value").rlike(pattern))
    return lines.agg(F.max_by("value", "idx").alias("value"))
