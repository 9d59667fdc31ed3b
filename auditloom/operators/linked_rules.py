"""Rules that look at rows of other tables by a key. The other side is aggregated by key first, then joined once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import amount as decimal
from ..functions.cells import blank, comparable, day, differs, number
from .verdict import ANOMALY, ARBITRATE, INFORMATION, finding, raw, verdict


def _bad_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_times``: how often the row's key stands in the whole table (``__times`` where rows were left out since). Counted apart, so no key is gathered."""
    if "__times" in df.columns:
        return df.withColumn("_times", F.col("__times"))
    return df.join(df.groupBy(key).agg(F.count("*").alias("_times")), key, "left")


def _own(v: DataFrame, df: DataFrame) -> DataFrame:
    return v.select(*df.columns, "state", "findings")


def unique_lookup(reference: DataFrame, key: str, columns: Sequence[str], prefix: str = "_ref_") -> DataFrame:
    """Rows of keys that stand once, with prefixed columns and ``_n``, the number of rows of the key (others have null columns)."""
    out = reference.where(~blank(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), *[F.first(c).alias(prefix + c) for c in columns])
    return out.select("_key", "_n", *[F.when(F.col("_n") == 1, F.col(prefix + c)).alias(prefix + c) for c in columns])


def total_of_lines(df: DataFrame, lines: DataFrame, key: str, total: str, line_key: str, amount: str, tolerance: float = 0.0, outcome: str = ANOMALY) -> DataFrame:
    """A header's total is the sum of its lines; no line is a finding, even if the total can't be read."""
    sums = lines.groupBy(F.col(line_key).alias(key)).agg(F.round(F.sum(decimal(F.col(amount))), 8).alias("_sum"), F.bool_or(decimal(F.col(amount)).isNull()).alias("_unread"), F.count("*").alias("_lines"))
    out = _bad_key(df, key).join(sums, key, "left")
    none = F.col("_lines").isNull()
    ok = ~blank(F.col(key)) & (F.col("_times") == 1) & (none | (number(F.col(total)).isNotNull() & ~F.col("_unread")))
    return _own(verdict(out, ok, [finding(none, "no_line", F.col(key), outcome), finding(~none & differs(F.col(total), F.col("_sum"), tolerance), "total_differs", F.round(F.col("_sum").cast("double"), 2), outcome)]), df)


def exists_in(df: DataFrame, key: str, reference: DataFrame, reference_key: str, how: str = "as_is", optional: bool = False, outcome: str = ANOMALY) -> DataFrame:
    """The key is in the reference; found only after normalisation is to arbitrate, with the reference's form if there is just one."""
    raw = reference.where(~blank(F.col(reference_key))).select(F.col(reference_key).cast("string").alias("_form")).distinct()
    exact = raw.select(comparable(F.col("_form"), how).alias("_x")).distinct().withColumn("_exact", F.lit(True))
    loose = raw.groupBy(comparable(F.col("_form"), "normalised").alias("_y")).agg(F.min("_form").alias("_proposal"), F.count("*").alias("_forms"))
    own = df.withColumn("_x", comparable(F.col(key), how)).withColumn("_y", comparable(F.col(key), "normalised"))
    out = own.join(exact, "_x", "left").join(loose, "_y", "left")
    missing, only_loose = F.col("_exact").isNull() & F.col("_forms").isNull(), F.col("_exact").isNull() & F.col("_forms").isNotNull()
    filled = ~blank(F.col(key))
    found = [finding(missing, "not_found", F.col(key), outcome), finding(only_loose, "found_after_normalisation", F.col(key), ARBITRATE, F.when(F.col("_forms") == 1, F.col("_proposal")))]
    return _own(verdict(out, filled, found, filled if optional else None), df)


def date_in_reference_period(df: DataFrame, key: str, date: str, reference: DataFrame, reference_key: str, start: str, end: str, outcome: str = ANOMALY) -> DataFrame:
    """The date lies in one of its key's periods, both ends included, an empty end open. A period without start makes failing dates not evaluable."""
    own = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_d", day(F.col(date)))
    periods = reference.select(F.col(reference_key).alias("_k"), day(F.col(start)).alias("_a"), day(F.col(end)).alias("_z"), blank(raw(reference, end)).alias("_open")).where(~blank(F.col("_k")))
    # The periods of a key are merged to one array of distinct ones: no row is multiplied by the join.
    byk = periods.groupBy("_k").agg(F.collect_set(F.when(F.col("_a").isNotNull() & (F.col("_open") | F.col("_z").isNotNull()), F.struct("_a", F.coalesce("_z", F.lit("9999-12-31").cast("date")).alias("_z")))).alias("_spans"), F.bool_or(F.col("_a").isNull() | (~F.col("_open") & F.col("_z").isNull())).alias("_unusable"))
    out = own.join(byk, own[key] == byk["_k"], "left")
    inside = F.exists(F.coalesce("_spans", F.array().cast("array<struct<_a:date,_z:date>>")), lambda p: (F.col("_d") >= p["_a"]) & (F.col("_d") <= p["_z"]))
    known = F.col("_k").isNotNull()
    ok = ~blank(F.col(key)) & F.col("_d").isNotNull() & (~known | inside | ~F.coalesce("_unusable", F.lit(False)))
    text = F.date_format("_d", "yyyy-MM-dd")
    return _own(verdict(out, ok, [finding(~known, "unknown_key", F.col(key), outcome), finding(known & ~inside, "outside_periods", text, outcome)]), df)


def year_in_reference(df: DataFrame, date: str, reference: DataFrame, year: str, outcome: str = ANOMALY) -> DataFrame:
    known = reference.select(number(F.col(year)).try_cast("int").alias("_y")).where("_y IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    out = df.withColumn("_y", F.year(day(F.col(date)))).join(known, "_y", "left")
    return _own(verdict(out, F.col("_y").isNotNull(), [finding(F.col("_known").isNull(), "year_absent", F.col("_y"), outcome)]), df)


def unique_link_in_delay(df: DataFrame, key: str, date: str, links: DataFrame, link_key: str, document: str, documents: DataFrame, document_key: str, document_date: str, least: int, most: int, cutoff: str, outcome: str = ANOMALY) -> DataFrame:
    """Just one distinct document is linked, dated ``least`` to ``most`` days after the row. None is information while the delay runs."""
    dated = unique_lookup(documents, document_key, [document_date], "_doc_")
    by_key = links.where(~blank(F.col(link_key))).groupBy(F.col(link_key).alias(key)).agg(F.count_distinct(document).alias("_docs"), F.min(document).alias("_doc"), F.bool_or(blank(F.col(document))).alias("_hollow"))
    out = _bad_key(df, key).join(by_key, key, "left").join(dated, F.col("_doc") == F.col("_key"), "left")
    d, none = day(F.col(date)), F.col("_docs").isNull()
    delay = F.datediff(day(F.col(f"_doc_{document_date}")), d)
    one = F.col("_docs") == 1
    ok = ~blank(F.col(key)) & (F.col("_times") == 1) & d.isNotNull() & (none | (~F.col("_hollow") & (~one | delay.isNotNull())))
    waiting = F.when(F.date_add(d, most) > F.lit(cutoff).cast("date"), INFORMATION).otherwise(outcome)
    found = [finding(none, "no_document", F.col(key), waiting), finding(F.col("_docs") > 1, "several_documents", F.col("_docs"), outcome), finding(one & (delay < least), "too_early", delay, outcome), finding(one & (delay > most), "too_late", delay, outcome)]
    return _own(verdict(out, ok, found), df)


def reference_conforms(df: DataFrame, key: str, reference: DataFrame, reference_key: str, conditions: Mapping[str, Sequence], exceptions: Mapping[str, Sequence] | None = None, outcome: str = ANOMALY) -> DataFrame:
    """The key's one reference row has an admitted value in each column; a row that an exception covers is information."""
    columns = list(dict.fromkeys([*conditions, *(exceptions or {})]))
    out = df.join(unique_lookup(reference, reference_key, columns), F.col(key) == F.col("_key"), "left")
    fits, hollow = F.lit(True), F.lit(False)
    for c, values in conditions.items():
        fits, hollow = fits & F.col(f"_ref_{c}").isin(list(values)), hollow | blank(F.col(f"_ref_{c}"))
    usual = F.lit(False)
    for c, values in (exceptions or {}).items():
        usual = usual | F.coalesce(F.col(f"_ref_{c}").isin(list(values)), F.lit(False))
    said = F.when(usual, INFORMATION).otherwise(outcome)
    return _own(verdict(out, (F.col("_n") == 1) & ~hollow, [finding(~fits, "does_not_conform", F.col(key), said)]), df)


def references_agree(df: DataFrame, first: tuple[str, DataFrame, str, str], second: tuple[str, DataFrame, str, str], how: str = "as_is", outcome: str = ANOMALY) -> DataFrame:
    """Two lookups, each (column, reference, its key, its value), give equal values."""
    out = df
    for i, (column, reference, key, value) in enumerate((first, second)):
        found = unique_lookup(reference, key, [value], f"_{i}_").select(F.col("_key").alias(f"_key{i}"), F.col("_n").alias(f"_n{i}"), F.col(f"_{i}_{value}").alias(f"_v{i}"))
        out = out.join(found, F.col(column) == F.col(f"_key{i}"), "left")
    x, y = comparable(F.col("_v0"), how), comparable(F.col("_v1"), how)
    return _own(verdict(out, ~blank(F.col("_v0")) & ~blank(F.col("_v1")), [finding(x != y, "values_differ", F.concat_ws(" | ", "_v0", "_v1"), outcome)]), df)


def no_linked_row(df: DataFrame, key: str, linked: DataFrame, linked_key: str, exception: Column | None = None, outcome: str = ANOMALY) -> DataFrame:
    """No linked row has the key. ``exception`` must hold for all linked rows to make it information."""
    usual = F.lit(False) if exception is None else F.coalesce(exception, F.lit(False))
    byk = linked.groupBy(F.col(linked_key).alias(key)).agg(F.count("*").alias("_rows"), F.bool_and(usual).alias("_usual"))
    out = df.join(byk, key, "left")
    return _own(verdict(out, ~blank(F.col(key)), [finding(F.col("_rows") > 0, "linked_row", F.col("_rows"), F.when(F.col("_usual"), INFORMATION).otherwise(outcome))]), df)


def linked_row_expected(df: DataFrame, key: str, linked: DataFrame, linked_key: str, conditions: Mapping[str, Sequence], outcome: str = ANOMALY) -> DataFrame:
    """One of the linked rows meets all conditions; without linked rows out of scope; not evaluable if none does and one has a blank."""
    fits, hollow = F.lit(True), F.lit(False)
    for c, values in conditions.items():
        fits, hollow = fits & F.coalesce(F.col(c).isin(list(values)), F.lit(False)), hollow | blank(F.col(c))
    byk = linked.groupBy(F.col(linked_key).alias(key)).agg(F.bool_or(fits).alias("_any"), F.bool_or(hollow).alias("_hollow"))
    out = df.join(byk, key, "left")
    return _own(verdict(out, ~blank(F.col(key)) & (F.col("_any") | ~F.col("_hollow")), [finding(~F.col("_any"), "no_row_meets", F.col(key), outcome)], F.col("_any").isNotNull() | blank(F.col(key))), df)


def conforms_by_hours(df: DataFrame, key: str, reference: DataFrame, reference_key: str, moment: str, inside: Callable[[Column], Column], within: Column, beyond: Column, outcome: str = ANOMALY) -> DataFrame:
    """The row meets ``within`` if its reference row's moment lies in the hours, else ``beyond``."""
    out = df.join(unique_lookup(reference, reference_key, [moment]), F.col(key) == F.col("_key"), "left")
    t = F.col(f"_ref_{moment}").try_cast("timestamp")
    found = [finding(inside(t) & ~within, "not_as_in_hours", F.col(key), outcome), finding(~inside(t) & ~beyond, "not_as_outside_hours", F.col(key), outcome)]
    return _own(verdict(out, t.isNotNull() & within.isNotNull() & beyond.isNotNull(), found), df)


def quantities_agree(df: DataFrame, key: str, a: DataFrame, b: DataFrame, detail: str, quantity: str, tolerance: float = 0.0, out_of_scope_without_b: bool = False, outcome: str = ANOMALY) -> DataFrame:
    """By key and detail the sum in ``a`` equals the sum in ``b`` (nothing counts as zero); one finding names all details that differ."""
    side = lambda x, s: x.select(F.col(key), F.col(detail).alias("_detail"), (decimal(F.col(quantity)) * s).cast("decimal(28,8)").alias("_q"), F.lit(s).alias("_side"))
    sums = side(a, 1).unionByName(side(b, -1)).groupBy(key, "_detail").agg(F.sum("_q").alias("_diff"), F.bool_or(F.col("_q").isNull() | blank(F.col("_detail"))).alias("_unread"), F.bool_or(F.col("_side") == -1).alias("_b"))
    off = F.abs(F.round(F.col("_diff").cast("double"), 9)) > tolerance
    byk = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.when(off, F.col("_detail").cast("string")))).alias("_off"), F.bool_or("_unread").alias("_unread"), F.bool_or("_b").alias("_b"))
    out = _bad_key(df, key).join(byk, key, "left")
    ok = ~blank(F.col(key)) & (F.col("_times") == 1) & ~F.coalesce("_unread", F.lit(False))
    scope = F.coalesce("_b", F.lit(False)) if out_of_scope_without_b else None
    return _own(verdict(out, ok, [finding(F.size(F.coalesce("_off", F.array().cast("array<string>"))) > 0, "quantities_differ", F.array_join("_off", ", "), outcome)], scope), df)


def linked_sum_rounded(df: DataFrame, key: str, target: str, linked: DataFrame, linked_key: str, amount: str, divisor: float, step: float, how: str = "up", least: float = 0.0, tolerance: float = 0.0, outcome: str = ANOMALY) -> DataFrame:
    """Sum of linked rows = value / divisor rounded to a step (``up``, ``down`` or ``nearest``), at least ``least``; none linked is out of scope."""
    sums = linked.groupBy(F.col(linked_key).alias(key)).agg(F.sum(decimal(F.col(amount))).alias("_sum"), F.bool_or(decimal(F.col(amount)).isNull()).alias("_unread"))
    out = _bad_key(df, key).join(sums, key, "left")
    q = F.round(number(F.col(target)) / divisor / step, 9)
    units = {"up": F.ceil(q), "down": F.floor(q), "nearest": F.floor(q + 0.5)}[how]
    expected = F.greatest(units.cast("double") * step, F.lit(float(least)))
    ok = ~blank(F.col(key)) & (F.col("_times") == 1) & number(F.col(target)).isNotNull() & ~F.col("_unread")
    return _own(verdict(out, ok, [finding(differs(F.col("_sum"), expected, tolerance), "differs_from_rounded", F.round(F.col("_sum").cast("double"), 4), outcome, F.round(expected, 4))], F.col("_unread").isNotNull()), df)


def linked_sums_agree(df: DataFrame, key: str, linked: DataFrame, linked_key: str, sums: Sequence[tuple[str, Column, Column]], same_date: tuple[str, str] | None = None, group: str | None = None, tolerance: float = 0.0, outcome: str = ANOMALY) -> DataFrame:
    """Several sums of linked rows, each (own amount, condition, signed amount), agree; one date and one group if asked. Findings in the order group, date, sums."""
    aggs = [F.sum(F.when(when, decimal(amount)).otherwise(F.lit(0))).alias(f"_s{i}") for i, (_, when, amount) in enumerate(sums)]
    unread = F.lit(False)
    for _, when, amount in sums:
        unread = unread | (when & decimal(amount).isNull())
    if same_date:
        aggs += [F.min(day(F.col(same_date[1]))).alias("_first"), F.max(day(F.col(same_date[1]))).alias("_last"), F.bool_or(day(F.col(same_date[1])).isNull()).alias("_undated")]
    if group:
        aggs.append(F.count_distinct(group).alias("_groups"))
    byk = linked.groupBy(F.col(linked_key).alias(key)).agg(F.bool_or(unread).alias("_unread"), F.count("*").alias("_rows"), *aggs)
    out = _bad_key(df, key).join(byk, key, "left")
    ok, off = ~blank(F.col(key)) & (F.col("_times") == 1) & (F.col("_rows").isNull() | ~F.col("_unread")), F.lit(False)
    for i, (own, _, _) in enumerate(sums):
        ok, off = ok & number(F.col(own)).isNotNull(), off | differs(F.col(own), F.coalesce(f"_s{i}", F.lit(0)), tolerance)
    found = []
    if group:
        found.append(finding(F.col("_groups") > 1, "several_groups", F.col("_groups"), outcome))
    if same_date:
        d = day(F.col(same_date[0]))
        ok = ok & d.isNotNull() & ~F.coalesce("_undated", F.lit(False))
        found.append(finding((F.col("_first") != d) | (F.col("_last") != d), "date_differs", F.date_format("_first", "yyyy-MM-dd"), outcome))
    found.append(finding(off, "sums_differ", F.concat_ws(" | ", *[F.round(F.coalesce(f"_s{i}", F.lit(0)).cast("double"), 2).cast("string") for i in range(len(sums))]), outcome))
    return _own(verdict(out, ok, found), df)
