"""What a person has to decide, and proposals for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdict import ARBITRATE


def swapped_date(d: Column, start: Column, end: Column) -> Column:
    """Day and month exchanged, where that is a real date in [start, end) and the date itself isn't; else null."""
    other = F.try_make_timestamp(F.year(d), F.dayofmonth(d), F.month(d), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    inside = lambda x: (x >= start) & (x < end)
    return F.when(~inside(d) & inside(other), other)


def to_arbitrate(register: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Findings to arbitrate by kind (cell, row, code, gap) and state of decision: none, valid, stale; decisions without finding are not_found."""
    from .register import with_decisions

    open_ = register.where(F.col("outcome") == ARBITRATE)
    kind = F.when(F.col("label") == "gap", "gap").when(F.col("label").isin("found_after_normalisation", "not_found"), "code").when(F.col("value").isNull(), "row").otherwise("cell")
    out = open_.withColumn("kind", kind)
    if decisions is None:
        return out.withColumn("decision", F.lit(None).cast("string")).withColumn("decision_state", F.lit("none"))
    lost = decisions.join(register.select("id"), "id", "left_anti").select("id", "decision", F.lit("not_found").alias("decision_state"))
    return with_decisions(out, decisions).unionByName(lost, allowMissingColumns=True)


def keyed_fingerprint(value: Column, key: bytes) -> Column:
    """Sixteen hex digits of the HMAC-SHA-256 of a text, from ``sha2`` alone."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in padded))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(value, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 16)


def suspect_encoding(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, cells, distinct, repairable, repaired_elsewhere): texts that read as wrongly decoded, by column."""
    from .clean import mojibake
    from .profile import cells

    all_cells = cells(df, columns)
    fixed = mojibake(all_cells, "value")
    hit = all_cells.join(fixed, F.col("value") == F.col("text"))
    there = all_cells.select(F.col("value").alias("repaired")).distinct().withColumn("_there", F.lit(True))
    out = hit.groupBy("column", "value", "repaired").agg(F.count("*").alias("n")).join(there, "repaired", "left")
    return out.groupBy("column").agg(F.sum("n").alias("cells"), F.count("*").alias("distinct"), F.count("repaired").alias("repairable"), F.count_if("_there").alias("repaired_elsewhere"))


def header_inherits(lines: DataFrame, line_key: str, headers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``lines`` with their header's columns and header_state: attached, blank or not_found."""
    from ..functions.cells import blank

    one = headers.groupBy(F.col(key).alias("_key")).agg(*[F.first(c).alias(c) for c in columns], F.lit(True).alias("_is"))
    out = lines.join(one, F.col(line_key) == F.col("_key"), "left")
    state = F.when(blank(F.col(line_key)), "blank").when(F.col("_is").isNull(), "not_found").otherwise("attached")
    return out.withColumn("header_state", state).drop("_key", "_is")
