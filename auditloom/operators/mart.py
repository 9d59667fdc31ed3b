"""Dimensions, facts and calculations of a star schema, and the checks that hold it to its sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cells import blank

#: Members that every dimension has: no key given, key not found.
BLANK_MEMBER, UNKNOWN_MEMBER = -1, -2


def calendar(spark: SparkSession, first_year: int, last_year: int, holidays: Mapping[int, Sequence[str]] | None = None) -> DataFrame:
    """A row for each day: date_key (yyyymmdd), date, year, quarter, month, day, weekday (1 is Monday), is_holiday (null for years without list), is_workday."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first_year:04d}-01-01', DATE'{last_year:04d}-12-31', INTERVAL 1 DAY)) AS date")
    d = F.col("date")
    listed = [x for y in (holidays or {}).values() for x in y]
    holiday = F.when(F.year(d).isin(list(holidays)), F.date_format(d, "yyyy-MM-dd").isin(listed)) if holidays else F.lit(None).cast("boolean")
    out = days.select(F.date_format(d, "yyyyMMdd").cast("long").alias("date_key"), "date", F.year(d).cast("long").alias("year"), F.quarter(d).cast("long").alias("quarter"), F.month(d).cast("long").alias("month"), F.dayofmonth(d).cast("long").alias("day"), (F.weekday(d) + 1).cast("long").alias("weekday"), holiday.alias("is_holiday"))
    return out.withColumn("is_workday", (F.col("weekday") <= 5) & ~F.coalesce("is_holiday", F.lit(False)))


def easter(year: int) -> tuple[int, int]:
    """(month, day) of Easter Sunday, by the anonymous Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * w) // 451
    return (h + w - 7 * m + 114) // 31, (h + w - 7 * m + 114) % 31 + 1


def french_holidays(year: int) -> list[str]:
    """ISO dates of the eleven public holidays."""
    import datetime

    sunday = datetime.date(year, *easter(year))
    moving = [sunday + datetime.timedelta(days=n) for n in (1, 39, 50)]
    fixed = [(1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)]  # fixed values
    return sorted(d.isoformat() for d in [*moving, *(datetime.date(year, m, d) for m, d in fixed)])


def dimension(df: DataFrame, code: str, attributes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """key, code, attributes of each code's first row, and its number of rows; keys follow the codes' binary order.

    Keys are a rank over distinct codes only; members -1 and -2 come on top.
    """
    rows = df.where(~blank(F.col(code))).groupBy(F.col(code).cast("string").alias("code")).agg(F.min_by(F.struct(*attributes), F.struct(*order)).alias("a") if attributes else F.lit(None).alias("a"), F.count("*").alias("rows"))
    ranged = rows.withColumn("key", _dense(rows, "code"))
    out = ranged.select("key", "code", *[F.col(f"a.{c}").alias(c) for c in attributes], "rows")
    members = out.sparkSession.createDataFrame([(BLANK_MEMBER, "(blank)"), (UNKNOWN_MEMBER, "(not found)")], "key long, code string")
    return out.unionByName(members, allowMissingColumns=True)


def _dense(df: DataFrame, column: str) -> Column:
    """1, 2, 3, ... in the column's order."""
    return F.row_number().over(Window.orderBy(column)).cast("long")


def member(key: Column, found: Column) -> Column:
    """A fact's key: -1 where its own is blank, -2 where the dimension lacks it."""
    return F.when(blank(key), F.lit(BLANK_MEMBER).cast("long")).otherwise(F.coalesce(found, F.lit(UNKNOWN_MEMBER).cast("long")))


def fact(df: DataFrame, dimensions: Mapping[str, tuple[str, DataFrame]], measures: Sequence[str]) -> DataFrame:
    """Keys and measures: ``dimensions`` gives, by the key's name, the column and its dimension. Left joins, so each row stays once."""
    out = df
    for name, (column, dim) in dimensions.items():
        found = dim.where("key > 0").select(F.col("code").alias("_code"), F.col("key").alias("_key"))
        out = out.join(found, F.col(column).cast("string") == F.col("_code"), "left").withColumn(name, member(F.col(column), F.col("_key"))).drop("_code", "_key")
    return out.select(*dimensions, *measures)


def most_frequent(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n): each key's most frequent label; filled ones first, then by count, then in binary order."""
    each = df.groupBy(key, label).agg(F.count("*").alias("n"))
    order = [F.col(label).isNull(), F.desc("n"), F.col(label)]
    return each.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def as_of(df: DataFrame, key: str, date: str, rates: DataFrame, rate_key: str, rate_date: str, value: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``df`` with the values of its key's latest rate on or before its date: one sort of both sides by key, no range join."""
    own = df.withColumn("_k", F.col(key)).withColumn("_t", F.col(date).cast("timestamp"))
    left = own.select("_k", "_t", F.lit(1).alias("_side"), F.struct(*df.columns).alias("_row"), F.lit(None).alias("_o"))
    held = F.struct(*[F.col(c).alias(f"{c}") for c in value])
    ranks = F.struct(*[F.col(c) for c in order]) if order else F.lit(None)
    right = rates.select(F.col(rate_key).alias("_k"), F.col(rate_date).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), ranks.alias("_o"), held.alias("_v"))
    both = left.drop("_o").unionByName(right, allowMissingColumns=True)
    run = Window.partitionBy("_k").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(run)).where("_side = 1")
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns], *[F.col(f"_v.{c}").alias(c) for c in value])


def month_end_cost(stock: Column, cost: Column, quantity: Column, value: Column) -> Column:
    """Weighted unit cost after a month's purchases, rounded half up to four places.

    Stock at or under zero, or without a cost, weighs nothing; without purchases
    or with a divisor at or under zero the cost stays.
    """
    d = lambda c: c.cast("decimal(18,6)")
    held = F.when((stock > 0) & cost.isNotNull(), d(stock)).otherwise(d(F.lit(0)))
    top = (held * F.coalesce(d(cost), d(F.lit(0)))).cast("decimal(28,8)") + d(value)
    bottom = held + d(quantity)
    return F.when((quantity == 0) | (bottom <= 0), cost).otherwise(F.round((top.cast("decimal(28,8)") / bottom.cast("decimal(18,6)")).cast("decimal(28,8)"), 4)).cast("decimal(19,4)")


def monthly_costs(months: DataFrame, item: str) -> DataFrame:
    """(item, month, stock, cost_start, cost_end) from (item, month, bought, value, used): a fold over each item's months.

    Each month's cost comes from the rounded cost of the month before, so no
    window sum can express it; an item has at most as many months as there are.
    """
    dec = "decimal(18,6)"
    rows = months.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("month", F.col("bought").cast(dec).alias("bought"), F.col("value").cast(dec).alias("value"), F.col("used").cast(dec).alias("used")))).alias("m"))
    kind = "struct<stock:decimal(18,6),cost:decimal(19,4),out:array<struct<month:string,stock:decimal(18,6),cost_start:decimal(19,4),cost_end:decimal(19,4)>>>"
    start = F.struct(F.lit(0).cast(dec).alias("stock"), F.lit(None).cast("decimal(19,4)").alias("cost"), F.array().cast("array<struct<month:string,stock:decimal(18,6),cost_start:decimal(19,4),cost_end:decimal(19,4)>>").alias("out"))

    def fold(acc, x):
        after = month_end_cost(acc["stock"], acc["cost"], x["bought"], x["value"])
        row = F.struct(x["month"].cast("string").alias("month"), acc["stock"].alias("stock"), acc["cost"].alias("cost_start"), after.alias("cost_end"))
        return F.struct((acc["stock"] + x["bought"] - x["used"]).cast(dec).alias("stock"), after.alias("cost"), F.concat(acc["out"], F.array(row)).alias("out")).cast(kind)

    done = rows.select(item, F.explode(F.aggregate("m", start.cast(kind), fold)["out"]).alias("r"))
    return done.select(item, "r.month", "r.stock", "r.cost_start", "r.cost_end")


def jobs(df: DataFrame, group: Sequence[str], row: str) -> DataFrame:
    """Rows of groups of two or more, with the group's first row, its size and each row's place."""
    w = Window.partitionBy(*group)
    out = df.withColumn("size", F.count("*").over(w)).where("size > 1").withColumn("place", F.row_number().over(w.orderBy(row)).cast("long"))
    return out.withColumn("first", F.min(row).over(w))


def margin(revenue: Column, *costs: Column) -> Column:
    """Revenue less costs in cents; null if any part is."""
    out = revenue.cast("decimal(19,2)")
    for c in costs:
        out = out - c.cast("decimal(19,2)")
    return out.cast("decimal(19,2)")


def first_reason(*reasons: tuple[Column, str]) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(None).cast("string")
    for when, name in reversed(reasons):
        out = F.when(F.coalesce(when, F.lit(False)), name).otherwise(out)
    return out


def hold_totals(checks: Mapping[str, tuple[DataFrame, Column, DataFrame, Column]]) -> DataFrame:
    """(check, expected, obtained, conform): an aggregate of the source against one of the fact, for each check."""
    out = None
    for name, (source, expected, target, obtained) in checks.items():
        both = source.agg(expected.cast("decimal(38,4)").alias("expected")).crossJoin(target.agg(obtained.cast("decimal(38,4)").alias("obtained")))
        part = both.select(F.lit(name).alias("check"), "expected", "obtained", F.col("expected").eqNullSafe(F.col("obtained")).alias("conform"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no checks were given")
    return out
