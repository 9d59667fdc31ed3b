"""Rules on small scenarios with exact expected rows, and the accounting of every row."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import linked_rules, row_rules, sequence_rules
from auditloom.operators.rules import TYPES, Rule, RuleErrors, evaluate, evaluate_rows, problems
from auditloom.operators.verdict import findings, first_copies, report, summary, without_surplus


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_catalogue_has_every_type():
    assert len(TYPES) == 31


def test_range_counts_every_row(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "id int, x double")
    v = row_rules.in_range(df, "x", 10, 40)
    assert rows(report(v, "id").select("id", "state", "label")) == [(1, "controlled", "below_minimum"), (2, "not_evaluable", None), (3, "controlled", "above_maximum")]
    s = summary(v).first()
    assert (s.rows, s.controlled, s.not_evaluable, s.out_of_scope, s.surplus, s.rows_in_anomaly) == (3, 2, 1, 0, 0, 2)


def test_period_proposes_the_same_day(spark):
    df = spark.createDataFrame([(1, "2024-02-10", "2025"), (2, "2024-02-29", "2025"), (3, "2025-03-01", "2025-03"), (4, None, "2025"), (5, "2025-01-01", "x")], "id int, d string, p string")
    out = report(row_rules.date_in_period(df, "d", "p"), "id").select("id", "state", "label", "proposal")
    assert rows(out) == [(1, "controlled", "before_period", "2025-02-10"), (2, "controlled", "before_period", None), (3, "controlled", None, None), (4, "not_evaluable", None, None), (5, "not_evaluable", None, None)]


def test_ratio_with_zero_denominator(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 2.0), (3, None, 1.0)], "id int, a double, b double")
    out = report(row_rules.ratio_in_range(df, "a", "b", 1.0, None), "id").select("id", "state", "label")
    assert rows(out) == [(1, "controlled", "zero_denominator"), (2, "controlled", "below_minimum"), (3, "not_evaluable", None)]


def test_dates_ordered_labels(spark):
    df = spark.createDataFrame([(1, "2025-01-10", "2025-01-01"), (2, "2025-01-01", "2025-01-02"), (3, "2025-01-01", "2025-03-01"), (4, "2025-01-01", None)], "id int, a string, b string")
    out = report(row_rules.dates_ordered(df, "a", "b", 3, 30, end_optional=True), "id").select("id", "state", "label")
    assert rows(out) == [(1, "controlled", "end_before_start"), (2, "controlled", "too_short"), (3, "controlled", "too_long"), (4, "out_of_scope", None)]


def test_numbering_gap_is_carried_by_the_next_number(spark):
    df = spark.createDataFrame([(1, "A-2025-01"), (2, "A-2025-04"), (3, "A-2025-04"), (4, "A-2024-07"), (5, "odd")], "id int, n string")
    v = sequence_rules.continuous_numbering(df, "n", r"A-(\d{4})-(\d+)", ["id"], number=2, series=[1])
    assert rows(findings(v, "id").select("id", "value")) == [(2, "2-3")]
    assert rows(v.where("state = 'not_evaluable'").select("id")) == [(5,)]


def test_chronology_looks_at_the_last_dated_number(spark):
    df = spark.createDataFrame([(1, "1", "2025-01-05"), (2, "2", None), (3, "3", "2025-01-04"), (4, "4", "2025-01-06")], "id int, n string, d string")
    v = sequence_rules.chronological_numbering(df, "n", r"(\d+)", "d", ["id"])
    assert rows(findings(v, "id").select("id", "value")) == [(3, "2025-01-05")]


def test_overlap_compares_with_the_interval_that_ends_last(spark):
    data = [(1, "g", "2025-01-01 23:00:00", 120), (2, "g", "2025-01-01 23:10:00", 10), (3, "g", "2025-01-02 00:30:00", 10), (4, "g", "2025-01-02 01:02:00", 5), (5, "", "2025-01-02 01:02:00", 5), (6, "g", "2025-01-03 00:00:00", -1)]
    df = spark.createDataFrame(data, "id int, g string, t string, m int")
    v = sequence_rules.no_overlap(df, "g", F.col("t").cast("timestamp"), F.col("m"), ["id"], 5)
    assert rows(findings(v, "id").select("id", "label")) == [(2, "overlap"), (3, "overlap"), (4, "too_close")]
    assert rows(v.where("state = 'not_evaluable'").select("id")) == [(5,), (6,)]


def test_gap_is_counted_from_the_second_nearest_to_the_start(spark):
    starts = {"g": "2025-01-01 00:05:59.7", "h": "2025-01-01 00:05:59.4", "i": "2025-01-01 00:05:59.5", "j": "2025-01-01 00:05:58.5"}
    data = [(i, g, t, 1) for i, (g, t) in enumerate([(g, "2025-01-01 00:00:00.9") for g in starts] + list(starts.items()))]
    df = spark.createDataFrame(data, "id int, g string, t string, m int")
    v = sequence_rules.no_overlap(df, "g", F.col("t").cast("timestamp"), F.col("m"), ["id"], 5)
    assert rows(findings(v, "g").select("g", "label")) == [("h", "too_close"), ("j", "too_close")]


def test_balance_arms_again_after_recovering(spark):
    exits = spark.createDataFrame([(1, "k", "2025-01-02", 15), (2, "k", "2025-01-03", 5), (3, "k", "2025-01-06", 30)], "id int, k string, d string, q int")
    entries = spark.createDataFrame([(9, "k", "2025-01-05", 20)], "id int, k string, d string, q int")
    initial = spark.createDataFrame([("k", 10)], "k string, initial int")
    v = sequence_rules.balance_never_negative(exits, entries, initial, "k", "d", "q", ["id"])
    assert rows(findings(v, "id").select("id", "label", "outcome")) == [(1, "turns_negative", "anomaly"), (2, "still_negative", "information"), (3, "turns_negative", "anomaly")]


def test_balance_is_blocked_by_what_cannot_be_read(spark):
    exits = spark.createDataFrame([(1, "k", "2025-01-02", None), (2, "j", "2025-01-03", 5)], "id int, k string, d string, q int")
    v = sequence_rules.balance_never_negative(exits, exits.limit(0), spark.createDataFrame([("k", 10)], "k string, initial int"), "k", "d", "q", ["id"])
    assert rows(v.select("id", "state")) == [(1, "not_evaluable"), (2, "not_evaluable")]


def test_header_total_without_lines_is_a_finding_even_if_unreadable(spark):
    head = spark.createDataFrame([(1, None), (2, 10.0), (3, 10.0), (4, 1.0), (4, 1.0)], "id int, total double")
    lines = spark.createDataFrame([(2, 4.0), (2, 6.0), (3, None), (4, 1.0)], "id int, amount double")
    v = linked_rules.total_of_lines(head, lines, "id", "total", "id", "amount")
    assert rows(report(v, "id").select("id", "state", "label")) == [(1, "controlled", "no_line"), (2, "controlled", None), (3, "not_evaluable", None), (4, "not_evaluable", None), (4, "not_evaluable", None)]


def test_reference_found_after_normalisation(spark):
    df = spark.createDataFrame([(1, "Élan"), (2, "elan "), (3, "zzz"), (4, " ")], "id int, k string")
    ref = spark.createDataFrame([("Élan",)], "k string")
    v = linked_rules.exists_in(df, "k", ref, "k", optional=True)
    assert rows(report(v, "id").select("id", "state", "label", "proposal")) == [(1, "controlled", None, None), (2, "controlled", "found_after_normalisation", "Élan"), (3, "controlled", "not_found", None), (4, "out_of_scope", None, None)]


def test_steps_cover_each_period(spark):
    periods = spark.createDataFrame([("a", "2025-01-01", "2025-03-31"), ("a", "2025-04-01", "2025-06-30"), ("b", "2025-01-01", None)], "k string, s string, e string")
    steps = spark.createDataFrame([("a", "2024-12-01"), ("b", "2025-02-01")], "k string, d string")
    v = sequence_rules.steps_cover(periods, steps, "k", "s", "e", "k", "d")
    assert rows(findings(v, "k", "s").select("k", "s")) == [("a", "2025-04-01"), ("b", "2025-01-01")]


def test_period_totals_are_blocked_by_a_row_without_period(spark):
    a = spark.createDataFrame([("2025", 1.0), (None, 1.0)], "p string, x double")
    b = spark.createDataFrame([("2025", 2.0)], "p string, x double")
    assert rows(sequence_rules.period_totals(a, b, "p", "x").select("p", "state")) == [("2025", "not_evaluable")]
    assert rows(findings(sequence_rules.period_totals(b, a.where("p IS NOT NULL"), "p", "x"), "p").select("p", "value")) == [("2025", "1.0")]


def test_problems_are_all_listed(spark):
    rules = [Rule("A", "", "range", "t", {"column": "y"}), Rule("A", "", "nothing", "t"), Rule("B", "", "ratio", "u", {}, outcome="odd")]
    tables = {"t": spark.createDataFrame([(1,)], "x int")}
    assert len(problems(rules, tables)) >= 6
    with pytest.raises(RuleErrors):
        evaluate(tables, rules)


def test_view_scope_and_states_add_up(spark):
    df = spark.createDataFrame([(1, "a", 5.0, 1.0), (1, "a", 5.0, 1.0), (2, "b", None, 1.0), (3, "x", 5.0, 5.0)], "id int, s string, debit double, credit double")
    rule = Rule("R", "", "group_balance", "t", {"group": "s", "debit": "debit", "credit": "credit"}, scope=(("s", ("a", "b"), None),))
    s = summary(evaluate({"t": df}, [rule], {"t": ["id"]})["R"]).first()
    assert (s.rows, s.surplus, s.out_of_scope, s.not_evaluable, s.controlled, s.rows_in_anomaly) == (4, 1, 1, 1, 1, 1)


def test_rules_of_one_table_share_a_scan(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 50.0)], "id int, x double")
    rules = [Rule("LOW", "", "range", "t", {"column": "x", "low": 10.0}), Rule("HIGH", "", "range", "t", {"column": "x", "high": 40.0})]
    assert rows(evaluate_rows(df, rules, ["id"]).where("label IS NOT NULL").select("id", "rule", "label")) == [(1, "LOW", "below_minimum"), (2, "HIGH", "above_maximum")]


def states(v, *keys):
    return rows(report(v, *keys).select(*keys, "state", "label"))


def test_unreadable_cells_are_not_evaluable(spark):
    df = spark.createDataFrame([(1, "5,5", "01/02/2025"), (2, "abc", "31/02/2025"), (3, " ", ""), (4, "50,0", "01/02/1990")], "id int, x string, d string")
    rules = [Rule("R", "", "range", "t", {"column": "x", "high": 40.0}), Rule("D", "", "date_plausible", "t", {"date": "d", "first": "2000-01-01", "cutoff": "2025-12-31"}), Rule("O", "", "dates_ordered", "t", {"start": "d", "end": "d", "end_optional": True})]
    natures = {"t": {"x": "decimal_comma", "d": "date_dmy"}}
    v = evaluate({"t": df}, rules, natures=natures)
    assert states(v["R"], "id") == [(1, "controlled", None), (2, "not_evaluable", None), (3, "not_evaluable", None), (4, "controlled", "above_maximum")]
    assert states(v["D"], "id") == [(1, "controlled", None), (2, "not_evaluable", None), (3, "not_evaluable", None), (4, "controlled", "too_early")]
    assert [s for _, s, _ in states(v["O"], "id")] == ["controlled", "not_evaluable", "out_of_scope", "controlled"]
    assert rows(v["R"].select("x")) == rows(df.select("x"))  # cells as they were loaded
    wide = evaluate_rows(df, rules[:2], ["id"], natures["t"])
    assert rows(wide.where("label IS NOT NULL").select("id", "rule", "label")) == [(4, "D", "too_early"), (4, "R", "above_maximum")]
    for f in (lambda: row_rules.in_range(df, "x", 1.0), lambda: row_rules.date_plausible(df, "d", "2000-01-01", "2025-12-31"), lambda: linked_rules.total_of_lines(df, df, "id", "x", "id", "x")):
        assert f().where("id = 2 AND state = 'not_evaluable'").count() == 1  # text never raises


def test_view_holds_for_linked_tables_and_keys_are_counted_before_the_scope(spark):
    heads = spark.createDataFrame([("a.csv", 1, 1, "x", 10.0), ("a.csv", 2, 2, "x", 10.0), ("b.csv", 1, 2, "y", 99.0), ("b.csv", 2, 1, "x", 10.0)], "source_file string, source_line int, id int, kind string, total double")
    lines = spark.createDataFrame([("a.csv", 1, 1, 10.0), ("b.csv", 1, 1, 10.0), ("a.csv", 2, 2, 10.0)], "source_file string, source_line int, id int, amount double")
    rule = Rule("R", "", "total_of_lines", "heads", {"lines": "lines", "key": "id", "total": "total", "line_key": "id", "amount": "amount"}, scope=(("kind", ("x",), None),))
    place = ["source_file", "source_line"]
    got = evaluate({"heads": heads, "lines": lines}, [rule], {"heads": place, "lines": place})["R"]
    assert rows(report(got, *place).select(*place, "state", "label")) == [("a.csv", 1, "controlled", None), ("a.csv", 2, "not_evaluable", None), ("b.csv", 1, "out_of_scope", None), ("b.csv", 2, "surplus", None)]
    with pytest.raises(RuleErrors, match="no total order of lines"):
        evaluate({"heads": heads, "lines": lines}, [rule], {"heads": place})


def test_numbering_over_many_ranges(spark):
    df = spark.range(500).where("id % 37 <> 5").selectExpr("id AS row", "concat('N', id) AS n", "date_add(DATE'2025-01-01', CAST(id AS int) - IF(id % 50 = 0, 10, 0)) AS d").repartition(7)
    v = sequence_rules.continuous_numbering(df, "n", r"N(\d+)", ["row"])
    assert rows(findings(v, "row").select("row", "value")) == sorted([(i + 1, f"{i}-{i}") for i in range(5, 500, 37)], key=str)
    v = sequence_rules.chronological_numbering(df, "n", r"N(\d+)", "d", ["row"])
    assert [r[0] for r in rows(findings(v, "row").select("row"))] == sorted([i for i in range(50, 500, 50) if i % 37 != 5], key=str)


def test_balance_order_may_be_text(spark):
    exits = spark.createDataFrame([("b.csv", "k", "2025-01-02", 5), ("a.csv", "k", "2025-01-02", 6)], "file string, k string, d string, q int")
    v = sequence_rules.balance_never_negative(exits, exits.limit(0), spark.createDataFrame([("k", 10)], "k string, initial int"), "k", "d", "q", ["file"])
    assert rows(findings(v, "file").select("file", "label")) == [("b.csv", "turns_negative")]


def test_first_copies_are_the_rows_without_surplus(spark):
    cells = ["Élan", "elan ", "b", None, "", " "]
    data = [(i, cells[i * 7 % 6], float(i * 5 % 3), "a.csv" if i * 11 % 4 else "b.csv") for i in range(60)] + [(None, None, None, "a.csv")] * 3
    df = spark.createDataFrame(data, "id int, x string, y double, source_file string").repartition(5)
    for columns, order in ([["x", "y"], ["y", "source_file", "id"]], [["x"], ["x", "id", "source_file"]], [["x", "y", "id"], ["id", "source_file"]]):
        want = without_surplus(df, columns, order).where("NOT surplus").drop("surplus")
        assert rows(first_copies(df, columns, order)) == rows(want)


def test_views_deal_out_each_row_once(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y")], "k int, t string, source_file string")
    order = {n: ["k", "t", "source_file"] for n in ("own", "linked")}
    v = evaluate({"own": df, "linked": df}, [Rule("R", "r", "no_linked_row", "own", {"key": "k", "linked": "linked", "linked_key": "k"})], order)["R"]
    found = findings(v, "k").select("k", "value")
    assert rows(found) == [(1, "1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "__salt" not in plan  # the findings alone: no key is copied to all salts
