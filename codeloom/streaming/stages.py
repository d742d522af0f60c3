"""Row stages and keyed deduplication on streams of files; what has arrived is worked off and the query ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.functions.predicates import body_like, continues_at_top, has_fill_mark, has_replacement
from codeloom.functions.texts import triple_key


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def audited(rows: DataFrame) -> DataFrame:
    """The flags of each row's output; stateless, so the same on streams and tables."""
    return rows.select("*", has_fill_mark("output").alias("fim"), has_replacement("output").alias("replacement_char"), continues_at_top("output").alias("top_level_continuation"), body_like("output").alias("body_like"))


def distinct_pairs(rows: DataFrame, *, arrival: str, delay: str) -> DataFrame:
    """The first of equal triples to arrive; state is kept for as long as ``delay`` after an arrival."""
    keyed = rows.withColumn("_key", triple_key("prompt", "chosen", "rejected")).withWatermark(arrival, delay)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def run_available(rows: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Works off all files that are there, exactly once: batches are written under their number, which a replay replaces."""

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def when_arrived(spark: SparkSession, path: str, pattern: str, checkpoint: str, then: Callable[[list[str]], None]) -> None:
    """Calls ``then`` with the files of a folder that arrived since the last call with this checkpoint."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path).select("path")

    def tell(batch: DataFrame, _: int) -> None:
        names = [r["path"] for r in batch.orderBy("path").collect()]
        if names:
            then(names)

    files.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


