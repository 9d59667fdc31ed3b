"""What a rule says of each row: out of scope, not evaluable, or controlled with any number of findings.

Every rule gives its table's rows back with ``state`` and ``findings``, an
array of (label, value, proposal, outcome). Rows that are out of scope or not
evaluable stay in the result, as they are counted: surplus + out of scope + not
evaluable + controlled is the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROLLED, NOT_EVALUABLE, OUT_OF_SCOPE, SURPLUS = "controlled", "not_evaluable", "out_of_scope", "surplus"
ANOMALY, ARBITRATE, INFORMATION = "anomaly", "to_arbitrate", "information"
NUMBERS = frozenset("tinyint smallint int bigint float double decimal".split())
FINDING = "array<struct<label:string,value:string,proposal:string,outcome:string>>"


def finding(when: Column, label: str, value: Column | None = None, outcome: str | Column = ANOMALY, proposal: Column | None = None) -> Column:
    """A finding where ``when`` is true."""
    shown = F.lit(None).cast("string")
    said = outcome if isinstance(outcome, Column) else F.lit(outcome)
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(
            F.lit(label).alias("label"),
            (shown if value is None else value.cast("string")).alias("value"),
            (shown if proposal is None else proposal.cast("string")).alias("proposal"),
            said.alias("outcome"),
        ),
    )


def verdict(df: DataFrame, evaluable: Column, findings: Sequence[Column], scope: Column | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with state and findings; ``scope`` and ``evaluable`` count as false where they are null."""
    yes = F.lit(True)
    state = F.when(~F.coalesce(yes if scope is None else scope, F.lit(False)), OUT_OF_SCOPE).when(~F.coalesce(evaluable, F.lit(False)), NOT_EVALUABLE).otherwise(CONTROLLED)
    out = df.withColumn("state", state)
    found = F.when(F.col("state") == CONTROLLED, F.array_compact(F.array(*findings))).otherwise(F.array())
    return out.withColumn("findings", found.cast(FINDING)).drop(*drop)


def report(v: DataFrame, *keys: str) -> DataFrame:
    """A row for each finding, and one without label for rows that have none."""
    out = v.select(*keys, "state", F.explode_outer("findings").alias("f"))
    return out.select(*keys, "state", "f.label", "f.value", "f.proposal", "f.outcome")


def findings(v: DataFrame, *keys: str) -> DataFrame:
    out = v.where(F.size("findings") > 0).select(*keys, F.explode("findings").alias("f"))
    return out.select(*keys, "f.label", "f.value", "f.proposal", "f.outcome")


def summary(v: DataFrame) -> DataFrame:
    """One row: numbers of rows in each state, of rows in anomaly and of findings, and the rate (null if nothing was controlled)."""
    bad = F.exists("findings", lambda f: f["outcome"] == ANOMALY)
    out = v.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col("state") == s).alias(s) for s in (SURPLUS, OUT_OF_SCOPE, NOT_EVALUABLE, CONTROLLED)],
        F.count_if(bad).alias("rows_in_anomaly"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long").alias("findings"),
    )
    return out.withColumn("rate", F.when(F.col(CONTROLLED) > 0, F.round(F.col("rows_in_anomaly") / F.col(CONTROLLED), 6)))


def condition(c: Column, values: Sequence | None = None, pattern: str | None = None) -> Column:
    """A filter's condition; a blank satisfies none."""
    from ..functions.cells import blank, full_match

    true = c.isin(list(values)) if values is not None else full_match(c, pattern or "")
    return F.coalesce(~blank(c) & true, F.lit(False))


def raw(df: DataFrame, c: str) -> Column:
    """The cell as it was loaded, where ``df`` holds it beside what was read from it."""
    return F.col(f"__raw_{c}" if f"__raw_{c}" in df.columns else c)


def _keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``__key``: 128 bits of the row after normalisation, null for rows of blanks alone."""
    from ..functions.cells import blank, normalise

    names, kinds = list(columns), dict(df.dtypes)
    form = lambda c: normalise(F.col(c)) if kinds[c] == "string" else F.col(c).cast("string")  # noqa: E731 - others are in normal form
    key = F.unhex(F.substring(F.sha2(F.to_json(F.struct(*[F.coalesce(form(c), F.lit("")).alias(f"c{i}") for i, c in enumerate(names)])), 256), 1, 32))
    hollow = F.lit(True)
    for c in names:
        hollow = hollow & blank(F.col(c))
    return df.withColumn("__key", F.when(~hollow, key))


def first_copies(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that ``without_surplus`` doesn't mark.

    Each task keeps one row of a key before rows are dealt out, so copies are
    never gathered, and they are dealt out once. Numbers are equal in all copies,
    so they tell none apart and aren't carried along for that.
    """
    kinds = dict(df.dtypes)
    apart = [c for c in order if c not in columns or kinds[c].split("(")[0] not in NUMBERS] or [F.lit(1)]
    keyed = _keyed(df, columns).withColumn("__row", F.when(F.col("__key").isNull(), F.monotonically_increasing_id()))
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("__key", "__row").orderBy(*apart)))
    return ranked.where("__rank = 1").select(*df.columns)


def without_surplus(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``surplus``: true for all but the first of rows that are equal after normalisation; rows of blanks alone have no copy.

    The first row is that by ``order`` (any of those that are equal in it, too).
    It is found map-side and joined to one row for each key, dealt out over
    salts, so copies are never gathered in one task.
    """
    place = F.struct(*order)
    keyed = _keyed(df, columns)
    keyed = keyed.withColumn("__salt", F.when(F.col("__key").isNull(), F.xxhash64(*order)).otherwise(F.pmod(F.xxhash64(*order), F.lit(16))))
    firsts = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.min(place).alias("__first"), F.count("*").alias("__size")).where("__size > 1").drop("__size")
    firsts = firsts.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    out = keyed.join(firsts, ["__key", "__salt"], "left").withColumn("__is", place == F.col("__first"))
    again = F.row_number().over(Window.partitionBy("__key", "__salt", "__is").orderBy(*order)) > 1
    return out.withColumn("surplus", F.coalesce(~F.col("__is") | again, F.lit(False)) & F.col("__first").isNotNull()).select(*df.columns, "surplus")
