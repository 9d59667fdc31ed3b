"""Rules that look at one row alone; rules of one table can share a scan (see ``rules.evaluate``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import blank, day, differs, number
from .verdict import ANOMALY, ARBITRATE, finding, raw, verdict


def period_bounds(period: Column) -> tuple[Column, Column]:
    """[start, end) of ``AAAA`` or ``AAAA-MM``; null if it is neither."""
    year = F.when(period.rlike(r"^\d{4}\z"), F.make_date(period.try_cast("int"), F.lit(1), F.lit(1)))
    month = F.when(period.rlike(r"^\d{4}-(0[1-9]|1[0-2])\z"), F.make_date(F.substring(period, 1, 4).try_cast("int"), F.substring(period, 6, 2).try_cast("int"), F.lit(1)))
    return F.coalesce(year, month), F.coalesce(F.add_months(year, 12), F.add_months(month, 1))


def date_in_period(df: DataFrame, date: str, period: str, blank_out_of_scope: bool = False, outcome: str = ARBITRATE) -> DataFrame:
    """The date lies in the row's export period; the same day in the period's year is proposed where it fits."""
    d = day(F.col(date))
    start, end = period_bounds(F.col(period))
    same = F.try_make_timestamp(F.year(start), F.month(d), F.dayofmonth(d), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    fit = F.when((same >= start) & (same < end), F.date_format(same, "yyyy-MM-dd"))
    scope = ~blank(raw(df, date)) if blank_out_of_scope else None
    text = F.date_format(d, "yyyy-MM-dd")
    return verdict(df, d.isNotNull() & start.isNotNull(), [finding(d < start, "before_period", text, outcome, fit), finding(d >= end, "after_period", text, outcome, fit)], scope)


def in_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None, outcome: str = ANOMALY) -> DataFrame:
    """Inclusive bounds, either optional."""
    c = number(F.col(column))
    return verdict(df, c.isNotNull(), _bounds(c, low, high, outcome, F.col(column)))


def _bounds(c: Column, low, high, outcome: str, value: Column | None = None) -> list[Column]:
    to = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = []
    if low is not None:
        out.append(finding(c < to(low), "below_minimum", c if value is None else value, outcome))
    if high is not None:
        out.append(finding(c > to(high), "above_maximum", c if value is None else value, outcome))
    return out


def range_by_value(df: DataFrame, column: str, by: str, ranges: Mapping[str, tuple[float | None, float | None]], outcome: str = ANOMALY) -> DataFrame:
    """The range depends on another column; a value without range isn't evaluable."""
    c, key = number(F.col(column)), F.col(by)
    low = F.create_map(*[x for k, (a, _) in ranges.items() for x in (F.lit(k), F.lit(a).cast("double"))])
    high = F.create_map(*[x for k, (_, b) in ranges.items() for x in (F.lit(k), F.lit(b).cast("double"))])
    known = F.coalesce(key.isin(list(ranges)), F.lit(False))
    return verdict(df, c.isNotNull() & known, _bounds(c, low[key], high[key], outcome))


def ratio_in_range(df: DataFrame, numerator: str, denominator: str, low: float | None, high: float | None, factor: float = 1.0, outcome: str = ANOMALY) -> DataFrame:
    """numerator * factor / denominator; a zero denominator is a finding."""
    a, b = number(F.col(numerator)), number(F.col(denominator))
    ratio = F.round(F.try_divide(a * F.lit(factor), b), 9)
    return verdict(df, a.isNotNull() & b.isNotNull(), [finding(b == 0, "zero_denominator", b, outcome), *_bounds(ratio, low, high, outcome)])


def outside_hours(df: DataFrame, moment: str, by: str, values: Sequence[str], slots: Mapping[int, Sequence[tuple[int, int]]], holidays: Mapping[int, Sequence[str]] | None = None, outcome: str = ANOMALY) -> DataFrame:
    """Outside the weekday's slots of minutes, ``by`` must have one of ``values``.

    ``slots``: weekday (0 is Monday) to [start, end) slots; holidays have none.
    ``holidays``: year to ISO dates; where given, other years aren't evaluable.
    """
    t, key = F.col(moment).try_cast("timestamp"), F.col(by)
    inside = inside_hours(t, slots, holidays)
    known = t.isNotNull()
    if holidays is not None:
        known = known & F.year(t).isin(list(holidays))
    allowed = F.coalesce(key.isin(list(values)), F.lit(False)) if values else F.lit(False)
    return verdict(df, known & (inside | ~blank(key)), [finding(~inside & ~allowed, "outside_hours", key, outcome)])


def inside_hours(t: Column, slots: Mapping[int, Sequence[tuple[int, int]]], holidays: Mapping[int, Sequence[str]] | None = None) -> Column:
    minute = F.hour(t) * 60 + F.minute(t)
    inside = F.lit(False)
    for day, spans in slots.items():
        for a, b in spans:
            inside = inside | ((F.weekday(t) == day) & (minute >= a) & (minute < b))
    days = [d for y in (holidays or {}).values() for d in y]
    return inside & ~F.date_format(t, "yyyy-MM-dd").isin(days) if days else inside


def equals_sum(df: DataFrame, target: str, terms: Mapping[str, float], tolerance: float = 0.0, outcome: str = ANOMALY) -> DataFrame:
    """target = sum of coefficient * column; any null isn't evaluable."""
    total = F.lit(0.0)
    for c, k in terms.items():
        total = total + number(F.col(c)) * F.lit(k)
    return verdict(df, number(F.col(target)).isNotNull() & total.isNotNull(), [finding(differs(F.col(target), total, tolerance), "differs_from_sum", F.col(target), outcome)])


def equals_product(df: DataFrame, target: str, factors: Sequence[Mapping], tolerance: float = 0.0, outcome: str = ANOMALY) -> DataFrame:
    """target = product of (constant + coefficient * column); ``blank`` of a factor is its value where the column is null."""
    product = F.lit(1.0)
    for f in factors:
        value = F.lit(float(f.get("constant", 0.0))) + F.lit(float(f.get("coefficient", 1.0))) * number(F.col(f["column"]))
        product = product * (F.when(blank(raw(df, f["column"])), F.lit(float(f["blank"]))).otherwise(value) if "blank" in f else value)
    return verdict(df, number(F.col(target)).isNotNull() & product.isNotNull(), [finding(differs(F.col(target), product, tolerance), "differs_from_product", F.col(target), outcome)])


def at_most_one_non_zero(df: DataFrame, columns: Sequence[str], at_least_one: bool = False, outcome: str = ANOMALY) -> DataFrame:
    """Of the columns at most one (if asked, exactly one) isn't zero; any null isn't evaluable."""
    known, n = F.lit(True), F.lit(0)
    for c in columns:
        known, n = known & number(F.col(c)).isNotNull(), n + (F.round(number(F.col(c)), 9) != 0).cast("int")
    found = [finding(n > 1, "several_non_zero", n, outcome)]
    if at_least_one:
        found.append(finding(n == 0, "all_zero", n, outcome))
    return verdict(df, known, found)


def filled_by_value(df: DataFrame, column: str, by: str, values: Sequence[str], blank_otherwise: bool = False, outcome: str = ANOMALY) -> DataFrame:
    """Filled where ``by`` has one of ``values``; blank for others if ``blank_otherwise``, else they are out of scope."""
    empty, among = blank(raw(df, column)), F.coalesce(F.col(by).isin(list(values)), F.lit(False))
    scope = None if blank_otherwise else among | blank(F.col(by))
    return verdict(df, ~blank(F.col(by)), [finding(among & empty, "missing", F.col(by), outcome), finding(~among & ~empty, "unexpected", F.col(column), outcome)], scope)


def dates_ordered(df: DataFrame, start: str, end: str, least: int = 0, most: int | None = None, end_optional: bool = False, outcome: str = ANOMALY) -> DataFrame:
    """end - start in days lies in [least, most]; one finding at most: end before start, too short, too long."""
    days = F.datediff(day(F.col(end)), day(F.col(start)))
    label = F.when(days < min(0, least), "end_before_start") if least <= 0 else F.when(days < 0, "end_before_start").when(days < least, "too_short")
    if least == 0:
        label = F.when(days < 0, "end_before_start")
    if most is not None:
        label = label.when(days > most, "too_long")
    found = [finding(label == x, x, days, outcome) for x in ("end_before_start", "too_short", "too_long")]
    return verdict(df, days.isNotNull(), found, ~blank(raw(df, end)) if end_optional else None)


def date_plausible(df: DataFrame, date: str, first: str, cutoff: str, margin: int = 0, outcome: str = ARBITRATE) -> DataFrame:
    """Not before ``first``, nor more than ``margin`` days after the cut-off."""
    d = day(F.col(date))
    text = F.date_format(d, "yyyy-MM-dd")
    return verdict(df, d.isNotNull(), [finding(d < F.lit(first).cast("date"), "too_early", text, outcome), finding(d > F.date_add(F.lit(cutoff).cast("date"), margin), "too_late", text, outcome)])
