"""Controls over streams: files that land, rules on each micro-batch, and figures by window with late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.rules import Rule, evaluate_rows


def landing(spark, path: str, schema: StructType, files_each: int = 100) -> DataFrame:
    """New Parquet files of a folder, so many for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def windowed_counts(stream: DataFrame, moment: str, by: Sequence[str], amount: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, by..., rows, total): rows later than the watermark are left out, the others counted in their window."""
    ready = stream.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, late)
    out = ready.groupBy(F.window(moment, width).alias("w"), *by).agg(F.count("*").alias("rows"), F.sum(amount).alias("total"))
    return out.select("w.start", "w.end", *by, "rows", "total")


def register_stream(stream: DataFrame, rules: Sequence[Rule], keys: Sequence[str], target: str, checkpoint: str) -> StreamingQuery:
    """Findings of row-local rules appended to ``target``; a batch that runs again replaces its own folder, so each finding stays once."""

    def write(df: DataFrame, batch: int) -> None:
        found = evaluate_rows(df, rules, keys).where("label IS NOT NULL")
        found.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
