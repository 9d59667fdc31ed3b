"""Duplicates: whole rows, declared values, rows equal but for their key, and documents with equal lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import blank, normalise
from .verdict import ANOMALY, ARBITRATE


def fingerprint(columns: Sequence[str], normalised: bool = True) -> Column:
    """128 bits of hex over the columns' texts; blanks are equal to each other."""
    cells = [F.coalesce(normalise(F.col(c)) if normalised else F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat(*[F.md5(c) for c in cells]))


def _all_blank(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & blank(F.col(c))
    return out


def _any_blank(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | blank(F.col(c))
    return out


def _grouped(df: DataFrame, skip: Column, differ: Sequence[str] | None, raw: Sequence[str], file: str | None, outcome: str, kind: str) -> DataFrame:
    """Rows of groups of two or more, joined to figures that were aggregated before: no group is gathered in one task."""
    own = df.columns
    keyed = df.where(~skip)
    aggs = [F.count("*").alias("size"), (F.min("_raw") != F.max("_raw")).alias("after_normalisation")]
    aggs.append((F.min(file) != F.max(file)).alias("across_files") if file else F.lit(False).alias("across_files"))
    if differ is not None:
        keyed = keyed.withColumn("_other", fingerprint(differ))
        aggs.append((F.min("_other") != F.max("_other")).alias("_differ"))
    keyed = keyed.withColumn("_raw", fingerprint(raw, False))
    groups = keyed.groupBy("_key").agg(*aggs).where("size > 1")
    if differ is not None:
        groups = groups.where("_differ").drop("_differ")
    out = keyed.join(groups, "_key")
    return out.select(*[c for c in own if c != "_key"], F.col("_key").alias("group"), "size", "across_files", "after_normalisation", F.lit(kind).alias("kind"), F.lit(outcome).alias("outcome"))


def exact(df: DataFrame, columns: Sequence[str], file: str | None = None) -> DataFrame:
    """Rows equal in all data columns after normalisation; rows of blanks alone aren't compared."""
    return _grouped(df.withColumn("_key", fingerprint(columns)), _all_blank(columns), None, columns, file, ANOMALY, "exact")


def repeated_value(df: DataFrame, key: Sequence[str], columns: Sequence[str], presumed: bool = False, file: str | None = None) -> DataFrame:
    """A declared value repeats on rows that differ elsewhere; rows with a blank in it aren't compared."""
    return _grouped(df.withColumn("_key", fingerprint(key)), _any_blank(key), columns, key, file, ARBITRATE if presumed else ANOMALY, "value")


def except_key(df: DataFrame, key: Sequence[str], columns: Sequence[str], file: str | None = None) -> DataFrame:
    """Rows equal but for the key, whose keys differ."""
    rest = [c for c in columns if c not in key]
    return _grouped(df.withColumn("_key", fingerprint(rest)), _all_blank(rest), key, rest, file, ARBITRATE, "except_key")


def documents_with_equal_lines(headers: DataFrame, key: str, columns: Sequence[str], lines: DataFrame, line_key: str, line_columns: Sequence[str]) -> DataFrame:
    """Headers equal but for their key that also have the same distinct lines.

    The lines of a header are compared by their number and two sums of hashes,
    which are added up map-side and don't depend on order.
    """
    each = lines.select(F.col(line_key).alias(key), fingerprint([c for c in line_columns if c != line_key]).alias("h")).distinct()
    number = lambda i: F.conv(F.substring("h", i, 15), 16, 10).cast("decimal(20,0)")
    marks = each.groupBy(key).agg(F.count("*").alias("_n"), F.sum(number(1)).alias("_s1"), F.sum(number(16)).alias("_s2"))
    both = headers.join(marks, key, "left").withColumn("_lines", F.concat_ws(":", F.coalesce("_n", F.lit(0)).cast("string"), F.col("_s1").cast("string"), F.col("_s2").cast("string"))).drop("_n", "_s1", "_s2")
    rest = [*[c for c in columns if c != key], "_lines"]
    return _grouped(both.withColumn("_key", fingerprint(rest)), F.lit(False), [key], rest, None, ARBITRATE, "document").drop("_lines")


def principal_codes(groups: DataFrame, code: str, order: Sequence[str]) -> DataFrame:
    """(code, principal): codes of one group of duplicates stand under the first in order."""
    first = groups.groupBy("group").agg(F.min_by(code, F.struct(*order)).alias("principal"))
    return groups.join(first, "group").where(F.col(code) != F.col("principal")).select(F.col(code).alias("code"), "principal").distinct()
