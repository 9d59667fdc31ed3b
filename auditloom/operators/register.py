"""The register of anomalies: stable ids, severities, what is kept, and what changed between two runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .verdict import ANOMALY, INFORMATION


def anomaly_id(*columns: str):
    """Twelve hex digits of a SHA-1 over the columns; a null counts as an empty text."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 12)


def unify(findings: Mapping[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(id, control, source, row, label, value, outcome) of findings by control: (table, findings, key column)."""
    out = None
    for control, (source, df, key) in findings.items():
        part = df.select(F.lit(control).alias("control"), F.lit(source).alias("source"), F.col(key).cast("string").alias("row"), "label", "value", "outcome")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no findings were given")
    return out.select(anomaly_id("control", "source", "row", "label").alias("id"), "*")


def affected(direct: Sequence[str], depends_on: Mapping[str, Sequence[str]]) -> list[str]:
    """The indicators that depend, however far, on those named; configuration only, so it stays on the driver."""
    out, todo = set(direct), list(direct)
    while todo:
        x = todo.pop()
        for name, needs in depends_on.items():
            if x in needs and name not in out:
                out.add(name)
                todo.append(name)
    return sorted(out)


def qualify(register: DataFrame, indicators: Mapping[str, Sequence[str]], exceptions: Mapping[str, str] | None = None) -> DataFrame:
    """Adds severity and indicators: an exception's severity, else major if an indicator is affected, else minor; information has none."""
    rows = [(c, list(i)) for c, i in indicators.items()]
    spark = register.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, "control string, indicators array<string>")) if rows else None  # configuration, one row for each control
    out = register.join(table, "control", "left") if table is not None else register.withColumn("indicators", F.array().cast("array<string>"))
    out = out.withColumn("indicators", F.coalesce("indicators", F.array().cast("array<string>")))
    severity = F.when(F.col("outcome") == INFORMATION, None)
    for control, s in (exceptions or {}).items():
        severity = severity.when(F.col("control") == control, s)
    return out.withColumn("severity", severity.when(F.size("indicators") > 0, "major").otherwise("minor"))


def control_summary(register: DataFrame, controlled: DataFrame) -> DataFrame:
    """(control, controlled, findings, rows_in_anomaly, rate) for every control of ``controlled`` (control, controlled)."""
    n = register.groupBy("control").agg(F.count("*").alias("findings"), F.count_distinct(F.when(F.col("outcome") == ANOMALY, F.col("row"))).alias("rows_in_anomaly"))
    out = controlled.join(n, "control", "left").select("control", "controlled", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("rows_in_anomaly", F.lit(0)).alias("rows_in_anomaly"))
    return out.withColumn("rate", F.when(F.col("controlled") > 0, F.round(F.col("rows_in_anomaly") / F.col("controlled"), 6)))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(control, resolved, appeared, changed, kept) between two registers, by id."""
    a, b = before.select("id", "control", "outcome"), after.select("id", F.col("control").alias("c2"), F.col("outcome").alias("o2"))
    both = a.join(b, "id", "full").select(F.coalesce("control", "c2").alias("control"), "outcome", "o2")
    return both.groupBy("control").agg(
        F.count_if(F.col("o2").isNull()).alias("resolved"),
        F.count_if(F.col("outcome").isNull()).alias("appeared"),
        F.count_if(F.col("outcome") != F.col("o2")).alias("changed"),
        F.count_if(F.col("outcome") == F.col("o2")).alias("kept"),
    )


def not_kept(register: DataFrame, blocking: Sequence[str], decisions: DataFrame | None = None) -> DataFrame:
    """(source, row) with a blocking anomaly that no decision (id) settles."""
    out = register.where((F.col("outcome") == ANOMALY) & F.col("control").isin(list(blocking)))
    if decisions is not None:
        out = out.join(decisions.select("id").distinct(), "id", "left_anti")
    return out.select("source", "row").distinct()


def with_decisions(register: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds decision and decision_state (none, valid, stale): a decision is stale if its fingerprint isn't the value's (SHA-1, 16 hex)."""
    own = F.substring(F.sha1(F.coalesce("value", F.lit(""))), 1, 16)
    d = decisions.select("id", F.col("decision"), F.col("fingerprint").alias("_f"))
    state = F.when(F.col("decision").isNull(), "none").when(F.col("_f") == own, "valid").otherwise("stale")
    return register.join(d, "id", "left").withColumn("decision_state", state).drop("_f")


def mask(df: DataFrame, columns: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """Values of sensitive columns are replaced when the plan is made, so none reaches a sink."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.lit("masked")).alias(c) if c in columns and c in sensitive else F.col(c) for c in df.columns])
