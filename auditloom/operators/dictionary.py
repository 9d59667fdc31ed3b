"""The dictionary of column rules: what was inferred, what is in force, and merging the two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("table", "column", "rule")


def merge(reviewed: DataFrame, generated: DataFrame) -> DataFrame:
    """(table, column, rule, proposal, in_force, status, event) from two tables of (table, column, rule, proposal, in_force, status).

    The proposal is always the new one. A rule that was reviewed keeps what is
    in force; others follow the proposal. Rules that aren't generated any more
    stay only if they were reviewed. event: added, kept, changed, followed,
    gone or removed.
    """
    a = reviewed.select(*KEYS, F.col("proposal").alias("p0"), F.col("in_force").alias("f0"), F.col("status").alias("s0"))
    b = generated.select(*KEYS, F.col("proposal").alias("p1"))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), list(KEYS), "full")
    human = F.coalesce(F.col("s0") == "reviewed", F.lit(False))
    same = F.col("p0").eqNullSafe(F.col("p1"))
    event = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull() & human, "gone").when(F.col("_b").isNull(), "removed").when(same, "kept").when(human, "changed").otherwise("followed")
    out = both.select(*KEYS, F.col("p1").alias("proposal"), F.when(human, F.col("f0")).otherwise(F.col("p1")).alias("in_force"), F.coalesce("s0", F.lit("proposed")).alias("status"), event.alias("event"))
    return out


def in_force(merged: DataFrame) -> DataFrame:
    return merged.where("event <> 'removed'").drop("event")


def mismatch(dictionary: DataFrame, loaded: DataFrame) -> DataFrame:
    """(table, column, problem): columns that the dictionary lacks, or that weren't loaded; must be empty before any control."""
    d = dictionary.select("table", "column").distinct().withColumn("_d", F.lit(True))
    both = d.join(loaded.select("table", "column").distinct().withColumn("_l", F.lit(True)), ["table", "column"], "full")
    return both.where(F.col("_d").isNull() | F.col("_l").isNull()).select("table", "column", F.when(F.col("_d").isNull(), "not_described").otherwise("not_loaded").alias("problem"))


def contract(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Every way in which the columns and kinds of ``df`` aren't those expected."""
    real = dict(df.dtypes)
    out = [f"{c} is missing" for c in expected if c not in real]
    return out + [f"{c} is {real[c]}, not {k}" for c, k in expected.items() if c in real and real[c] != k]


def parameters(used: DataFrame, column: str, listed: Sequence[str]) -> DataFrame:
    """(value, problem): values in use that the closed list lacks, and listed ones that nothing uses."""
    spark = used.sparkSession
    values = used.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().withColumn("_u", F.lit(True))
    known = spark.createDataFrame([(x, True) for x in listed], "value string, _k boolean")
    both = values.join(known, "value", "full")
    return both.where(F.col("_u").isNull() | F.col("_k").isNull()).select("value", F.when(F.col("_k").isNull(), "not_listed").otherwise("not_used").alias("problem"))
