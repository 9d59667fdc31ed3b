"""Each rule type on the driver's tables, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linked_rules as linked
from ..operators import row_rules as row
from ..operators import sequence_rules as seq
from ..operators.verdict import condition, findings, report, summary, without_surplus

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
SLOTS = seq.slots_of(range(5), [(480, 1020)])
HOURS = "(isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) >= 480 AND hour(ts) * 60 + minute(ts) < 1020)"


@register("""
    WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice::DECIMAL(28,8)), 8) AS total, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, 'controlled' AS state, CASE WHEN n IS NULL THEN 'no_line' WHEN abs(round(o_totalprice - total::DOUBLE, 9)) > 100000 THEN 'total_differs' END AS label,
           CASE WHEN n IS NOT NULL AND abs(round(o_totalprice - total::DOUBLE, 9)) > 100000 THEN round(total::DOUBLE, 2) END AS line_total
    FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def rule_header_total(spark, sf_dir):
    v = linked.total_of_lines(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "o_totalprice", "l_orderkey", "l_extendedprice", 100000.0)
    return report(v, "o_orderkey").select("o_orderkey", "state", "label", F.when(F.col("label") == "total_differs", F.col("value").cast("double")).alias("line_total"))


@register("""
    SELECT count(*) AS rows, 0::BIGINT AS surplus, count(*) FILTER (o_orderstatus = 'F') AS out_of_scope, 0::BIGINT AS not_evaluable, count(*) FILTER (o_orderstatus <> 'F') AS controlled,
           count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 300000) AS rows_in_anomaly, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 300000) AS findings,
           round(count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 300000) / count(*) FILTER (o_orderstatus <> 'F')::DOUBLE, 6) AS rate FROM orders""")
def rule_summary(spark, sf_dir):
    from ..operators.rules import Rule, evaluate

    rule = Rule("R1", "plain price", "range", "orders", {"column": "o_totalprice", "high": 300000.0}, scope=(("o_orderstatus", ("O", "P"), None),))
    return summary(evaluate({"orders": table(spark, sf_dir, "orders")}, [rule])["R1"])


@register(f"""SELECT {LINE_KEYS}, CASE WHEN l_quantity < 3 THEN 'below_minimum' ELSE 'above_maximum' END AS label FROM lineitem WHERE l_quantity < 3 OR l_quantity > 45""")
def rule_range(spark, sf_dir):
    return findings(row.in_range(table(spark, sf_dir, "lineitem"), "l_quantity", 3.0, 45.0), *LINE).select(*LINE, "label")


@register(f"""
    SELECT {LINE_KEYS}, CASE WHEN l_returnflag = 'N' THEN 'not_evaluable' ELSE 'controlled' END AS state,
           CASE WHEN l_returnflag = 'A' AND l_discount > 0.05 THEN 'above_maximum' WHEN l_returnflag = 'R' AND l_discount < 0.02 THEN 'below_minimum' END AS label FROM lineitem""")
def rule_range_by_value(spark, sf_dir):
    v = row.range_by_value(table(spark, sf_dir, "lineitem"), "l_discount", "l_returnflag", {"A": (None, 0.05), "R": (0.02, None)})
    return report(v, *LINE).select(*LINE, "state", "label")


@register(f"""
    SELECT {LINE_KEYS}, CASE WHEN l_discount = 0 THEN 'zero_denominator' ELSE 'above_maximum' END AS label
    FROM lineitem WHERE l_discount = 0 OR round(l_tax / l_discount, 9) > 4""")
def rule_ratio(spark, sf_dir):
    return findings(row.ratio_in_range(table(spark, sf_dir, "lineitem"), "l_tax", "l_discount", None, 4.0), *LINE).select(*LINE, "label")


@register("""
    SELECT event_id, CASE WHEN d < s THEN 'before_period' ELSE 'after_period' END AS label, strftime(d, '%Y-%m-%d') AS value FROM (
        SELECT event_id, ts::DATE AS d, date_trunc('month', ts - INTERVAL 5 DAY)::DATE AS s FROM events) WHERE d < s OR d >= s + INTERVAL 1 MONTH""")
def rule_date_in_period(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("period", F.date_format(F.col("ts") - F.expr("INTERVAL 5 DAYS"), "yyyy-MM"))
    return findings(row.date_in_period(events, "ts", "period"), "event_id").select("event_id", "label", "value")


@register(f"""
    SELECT {LINE_KEYS}, CASE WHEN d < 0 THEN 'end_before_start' ELSE 'too_long' END AS label, d::BIGINT AS days FROM (
        SELECT l.*, datediff('day', o_orderdate, l_shipdate) AS d FROM lineitem l JOIN orders ON l_orderkey = o_orderkey) WHERE d < 0 OR d > 60""")
def rule_dates_ordered(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return findings(row.dates_ordered(both, "o_orderdate", "l_shipdate", 0, 60), *LINE).select(*LINE, "label", F.col("value").cast("long").alias("days"))


@register("""SELECT o_orderkey, CASE WHEN o_orderdate::DATE < DATE '1995-07-01' THEN 'too_early' ELSE 'too_late' END AS label FROM orders WHERE o_orderdate::DATE < DATE '1995-07-01' OR o_orderdate::DATE > DATE '1998-07-01'""")
def rule_date_plausible(spark, sf_dir):
    return findings(row.date_plausible(table(spark, sf_dir, "orders"), "o_orderdate", "1995-07-01", "1998-06-01", 30), "o_orderkey").select("o_orderkey", "label")


@register(f"""SELECT event_id, event_type FROM events WHERE NOT {HOURS} AND event_type <> 'error'""")
def rule_outside_hours(spark, sf_dir):
    return findings(row.outside_hours(table(spark, sf_dir, "events"), "ts", "event_type", ["error"], SLOTS), "event_id").select("event_id", F.col("value").alias("event_type"))


@register(f"""SELECT {LINE_KEYS} FROM lineitem WHERE abs(round(l_extendedprice - (l_quantity * 1000.0 + l_tax * 10.0), 9)) > 5000""")
def rule_row_equality(spark, sf_dir):
    v = row.equals_sum(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"l_quantity": 1000.0, "l_tax": 10.0}, 5000.0)
    return findings(v, *LINE).select(*LINE)


@register(f"""SELECT {LINE_KEYS} FROM lineitem WHERE abs(round(l_extendedprice - l_quantity * (1000 + 100 * l_discount), 9)) > 20000""")
def rule_product(spark, sf_dir):
    factors = [{"column": "l_quantity"}, {"column": "l_discount", "constant": 1000.0, "coefficient": 100.0}]
    return findings(row.equals_product(table(spark, sf_dir, "lineitem"), "l_extendedprice", factors, 20000.0), *LINE).select(*LINE)


@register(f"""SELECT {LINE_KEYS}, CASE WHEN l_discount = 0 THEN 'all_zero' ELSE 'several_non_zero' END AS label FROM lineitem WHERE (l_discount = 0) = (l_tax = 0)""")
def rule_at_most_one(spark, sf_dir):
    return findings(row.at_most_one_non_zero(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], True), *LINE).select(*LINE, "label")


@register("""
    SELECT p_partkey, CASE WHEN p_size <= 10 AND p_type LIKE 'P%' THEN 'missing' WHEN p_size > 10 AND p_type NOT LIKE 'P%' THEN 'unexpected' END AS label
    FROM (SELECT p_partkey, p_size, coalesce(p_type, '') AS p_type FROM part)""")
def rule_filled_if(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("class", F.when(F.col("p_size") <= 10, "small").otherwise("large")).withColumn("note", F.when(F.coalesce("p_type", F.lit("")).like("P%"), " ").otherwise("x"))
    return report(row.filled_by_value(part, "note", "class", ["small"], True), "p_partkey").select("p_partkey", "label")


@register("""
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS b FROM d)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (b + 1) || '-' || (l_linenumber - 1) AS missing FROM g WHERE l_linenumber > b + 1""")
def rule_numbering_gaps(spark, sf_dir):
    v = seq.continuous_numbering(table(spark, sf_dir, "lineitem"), "l_linenumber", r"(\d+)", ["l_partkey", "l_suppkey", "l_extendedprice"], start=1, keys=["l_orderkey"])
    return findings(v, "l_orderkey", "l_linenumber").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("value").alias("missing"))


@register("""SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate::DATE AS d, lag(o_orderdate::DATE) OVER (ORDER BY o_orderkey) AS b FROM orders) WHERE d < b""")
def rule_numbering_chrono(spark, sf_dir):
    v = seq.chronological_numbering(table(spark, sf_dir, "orders"), "o_orderkey", r"(\d+)", "o_orderdate", ["o_orderkey"])
    return findings(v, "o_orderkey").select("o_orderkey")


@register("""
    WITH e AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS a, ts, ceil(value)::BIGINT AS m FROM events),
    o AS (SELECT *, a + m * 60 AS z FROM e WHERE m > 0),
    p AS (SELECT *, max(date_trunc('second', ts) + to_minutes(m)) OVER (PARTITION BY user_id ORDER BY ts, a + m * 60, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o)
    SELECT event_id, CASE WHEN ts < last THEN 'overlap' ELSE 'too_close' END AS label FROM p WHERE ts < last OR (a - epoch(last)::BIGINT) / 60.0 < 5""")
def rule_overlap(spark, sf_dir):
    v = seq.no_overlap(table(spark, sf_dir, "events"), "user_id", F.col("ts"), F.ceil("value").cast("long"), ["event_id"], 5)
    return findings(v, "event_id").select("event_id", "label")


@register("""
    WITH t AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS debit, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS credit FROM lineitem),
    g AS (SELECT l_suppkey, round((sum(debit::DECIMAL(28,8)) - sum(credit::DECIMAL(28,8)))::DOUBLE, 4) AS difference FROM t GROUP BY 1)
    SELECT l_suppkey, count(*) AS lines, any_value(difference) AS difference FROM t JOIN g USING (l_suppkey) WHERE abs(difference) > 100 GROUP BY 1""")
def rule_group_balance(spark, sf_dir):
    flag = lambda x: F.when(F.col("l_returnflag") == x, F.col("l_quantity")).otherwise(0.0)
    lines = table(spark, sf_dir, "lineitem").withColumn("debit", flag("R")).withColumn("credit", flag("A"))
    found = findings(seq.group_balance(lines, "l_suppkey", "debit", "credit", 100.0), "l_suppkey")
    return found.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.first(F.col("value").cast("double")).alias("difference"))


@register("""
    WITH o AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders GROUP BY 1),
    s AS (SELECT o_custkey AS k, o_orderdate::DATE AS t FROM orders WHERE o_orderstatus = 'F')
    SELECT o_custkey FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE k = o_custkey AND t <= a)""")
def rule_steps_cover(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    periods = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    v = seq.steps_cover(periods, orders.where("o_orderstatus = 'F'"), "o_custkey", "a", "z", "o_custkey", "o_orderdate")
    return findings(v, "o_custkey").select("o_custkey")


@register("""
    WITH m AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS kind, round(value, 2)::DECIMAL(28,8) AS q FROM events WHERE event_type IN ('purchase', 'view')),
    b AS (SELECT *, 100 + sum(CASE WHEN kind = 0 THEN q ELSE -q END) OVER w AS balance FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, kind, event_id)),
    s AS (SELECT *, sum(CASE WHEN balance >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, kind, event_id) AS seg FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS r FROM s WHERE kind = 1 AND balance < 0)
    SELECT event_id, CASE WHEN r = 1 THEN 'turns_negative' ELSE 'still_negative' END AS label, CASE WHEN r = 1 THEN 'anomaly' ELSE 'information' END AS outcome, round(balance::DOUBLE, 4) AS balance FROM n""")
def rule_balance_never_negative(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("q", F.round("value", 2))
    initial = events.select("user_id").distinct().withColumn("initial", F.lit(100))
    v = seq.balance_never_negative(events.where("event_type = 'view'").select("event_id", "user_id", "ts", "q"), events.where("event_type = 'purchase'"), initial, "user_id", "ts", "q", ["event_id"])
    return findings(v, "event_id").select("event_id", "label", "outcome", F.col("value").cast("double").alias("balance"))


@register("""
    WITH a AS (SELECT year(o_orderdate)::VARCHAR AS period, sum(o_totalprice::DECIMAL(28,8)) AS x FROM orders GROUP BY 1),
    b AS (SELECT year(l_shipdate)::VARCHAR AS period, sum(l_extendedprice::DECIMAL(28,8)) AS y FROM lineitem GROUP BY 1)
    SELECT period, round(coalesce(x, 0)::DOUBLE, 2) AS "left", round(coalesce(y, 0)::DOUBLE, 2) AS "right", CASE WHEN abs(round(coalesce(x, 0)::DOUBLE - coalesce(y, 0)::DOUBLE, 9)) > 1000 THEN 'totals_differ' END AS label
    FROM a FULL JOIN b USING (period)""")
def rule_period_totals(spark, sf_dir):
    year = lambda t, d, x: table(spark, sf_dir, t).select(F.year(d).cast("string").alias("period"), F.col(x).alias("amount"))
    v = seq.period_totals(year("orders", "o_orderdate", "o_totalprice"), year("lineitem", "l_shipdate", "l_extendedprice"), "period", "amount", tolerance=1000.0)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0)).cast("double"), 2).alias(c)
    return report(v, "period", "left", "right").select("period", zero("left"), zero("right"), "label")


@register("""
    SELECT doc_id, 'not_found' AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def rule_reference_exists(spark, sf_dir):
    v = linked.exists_in(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")
    return findings(v, "doc_id").select("doc_id", "label")


@register("""
    WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 7 = 0 THEN 'X' || c_mktsegment ELSE c_mktsegment END AS seg FROM customer),
    r AS (SELECT DISTINCT c_mktsegment AS form FROM customer)
    SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM r WHERE lower(form) = lower(seg)) THEN 'found_after_normalisation' ELSE 'not_found' END AS label,
           (SELECT min(form) FROM r WHERE lower(form) = lower(seg)) AS proposal
    FROM n WHERE seg NOT IN (SELECT form FROM r)""")
def rule_reference_normalised(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    seg = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("X"), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    v = linked.exists_in(customer.select("c_custkey", seg.alias("seg")), "seg", customer, "c_mktsegment")
    return findings(v, "c_custkey").select("c_custkey", "label", "proposal")


@register(f"""
    SELECT {LINE_KEYS}, 'outside_periods' AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_shipdate::DATE BETWEEN o_orderdate::DATE AND o_orderdate::DATE + 60)""")
def rule_date_in_reference_period(spark, sf_dir):
    periods = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("a"), F.date_add("o_orderdate", 60).alias("z"))
    v = linked.date_in_reference_period(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate", periods, "o_orderkey", "a", "z")
    return findings(v, *LINE).select(*LINE, "label")


@register("""SELECT o_orderkey, year(o_orderdate)::BIGINT AS year FROM orders WHERE year(o_orderdate) NOT IN (SELECT DISTINCT year(l_shipdate) FROM lineitem WHERE year(l_shipdate) % 2 = 0)""")
def rule_year_in_reference(spark, sf_dir):
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y")).where("y % 2 = 0")
    v = linked.year_in_reference(table(spark, sf_dir, "orders"), "o_orderdate", years, "y")
    return findings(v, "o_orderkey").select("o_orderkey", F.col("value").cast("long").alias("year"))


@register("""
    WITH d AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_shipdate)::DATE AS ship FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN n IS NULL THEN 'no_document' WHEN n > 1 THEN 'several_documents' WHEN ship < o_orderdate::DATE THEN 'too_early' ELSE 'too_late' END AS label,
           CASE WHEN n IS NULL AND o_orderdate::DATE + 30 > DATE '1998-06-30' THEN 'information' ELSE 'anomaly' END AS outcome
    FROM orders LEFT JOIN d ON o_orderkey = l_orderkey WHERE n IS NULL OR n > 1 OR ship < o_orderdate::DATE OR ship > o_orderdate::DATE + 30""")
def rule_unique_link_in_delay(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("doc"), "l_shipdate")
    documents = lines.groupBy("doc").agg(F.min("l_shipdate").alias("shipped"))
    v = linked.unique_link_in_delay(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", lines, "l_orderkey", "doc", documents, "doc", "shipped", 0, 30, "1998-06-30")
    return findings(v, "o_orderkey").select("o_orderkey", "label", "outcome")


@register("""SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'information' ELSE 'anomaly' END AS outcome FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')""")
def rule_reference_conform(spark, sf_dir):
    v = linked.reference_conforms(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", {"c_mktsegment": ["BUILDING", "AUTOMOBILE"]}, {"c_mktsegment": ["MACHINERY"]})
    return findings(v, "o_orderkey").select("o_orderkey", "outcome")


@register(f"""SELECT {LINE_KEYS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey""")
def rule_concordance(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    v = linked.references_agree(lines, ("o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey"), ("l_suppkey", table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey"))
    return findings(v, *LINE).select(*LINE)


@register("""
    SELECT o_orderkey, n AS lines, CASE WHEN early THEN 'information' ELSE 'anomaly' END AS outcome FROM orders JOIN (
        SELECT l_orderkey, count(*) AS n, bool_and(l_tax < 0.05) AS early FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey""")
def rule_no_linked(spark, sf_dir):
    v = linked.no_linked_row(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey", F.col("l_tax") < 0.05)
    return findings(v, "o_orderkey").select("o_orderkey", F.col("value").cast("long").alias("lines"), "outcome")


@register("""
    SELECT o_orderkey, CASE WHEN ok IS NULL THEN 'out_of_scope' ELSE 'controlled' END AS state, CASE WHEN NOT ok THEN 'no_row_meets' END AS label FROM orders LEFT JOIN (
        SELECT l_orderkey, bool_or(l_returnflag = 'N' AND l_linestatus = 'O') AS ok FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def rule_linked_expected(spark, sf_dir):
    v = linked.linked_row_expected(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey", {"l_returnflag": ["N"], "l_linestatus": ["O"]})
    return report(v, "o_orderkey").select("o_orderkey", "state", "label")


@register(f"""
    SELECT event_id, CASE WHEN {HOURS} THEN 'not_as_in_hours' ELSE 'not_as_outside_hours' END AS label FROM events
    WHERE ({HOURS} AND value >= 50) OR (NOT {HOURS} AND value < 20)""")
def rule_conform_by_hours(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    v = linked.conforms_by_hours(events.select("event_id", "value"), "event_id", events, "event_id", "ts", lambda t: row.inside_hours(t, SLOTS), F.col("value") < 50, F.col("value") >= 20)
    return findings(v, "event_id").select("event_id", "label")


@register("""
    WITH s AS (SELECT l_orderkey, l_linestatus AS d, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::DECIMAL(28,8) WHEN l_returnflag = 'A' THEN -l_quantity::DECIMAL(28,8) END) AS q FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2)
    SELECT o_orderkey, string_agg(d, ', ' ORDER BY d) AS details FROM orders JOIN s ON o_orderkey = l_orderkey WHERE abs(q) > 20 GROUP BY 1""")
def rule_quantities_match(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    v = linked.quantities_agree(table(spark, sf_dir, "orders"), "o_orderkey", lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "l_linestatus", "l_quantity", 20.0)
    return findings(v, "o_orderkey").select("o_orderkey", F.col("value").alias("details"))


@register("""
    WITH s AS (SELECT l_orderkey, sum(l_quantity::DECIMAL(28,8))::DOUBLE AS q FROM lineitem GROUP BY 1),
    e AS (SELECT o_orderkey, q, greatest(ceil(round(o_totalprice / 2000 / 10, 9)) * 10.0, 20.0) AS expected FROM orders JOIN s ON o_orderkey = l_orderkey)
    SELECT o_orderkey, round(q, 4) AS q, round(expected, 4) AS expected FROM e WHERE abs(round(q - expected, 9)) > 50""")
def rule_linked_sum_rounded(spark, sf_dir):
    v = linked.linked_sum_rounded(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", 2000.0, 10.0, "up", 20.0, 50.0)
    return findings(v, "o_orderkey").select("o_orderkey", F.col("value").cast("double").alias("q"), F.col("proposal").cast("double").alias("expected"))


@register("""
    WITH s AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice::DECIMAL(28,8) ELSE 0 END)::DOUBLE AS x, count(DISTINCT l_linestatus) AS g, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS z FROM lineitem GROUP BY 1)
    SELECT o_orderkey, unnest(list_filter([CASE WHEN g > 1 THEN 'several_groups' END, CASE WHEN a <> o_orderdate::DATE OR z <> o_orderdate::DATE THEN 'date_differs' END,
        CASE WHEN abs(round(o_totalprice - coalesce(x, 0), 9)) > 150000 THEN 'sums_differ' END], lambda v: v IS NOT NULL)) AS label FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def rule_linked_sums(spark, sf_dir):
    v = linked.linked_sums_agree(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey", [("o_totalprice", F.col("l_returnflag") == "N", F.col("l_extendedprice"))], ("o_orderdate", "l_shipdate"), "l_linestatus", 150000.0)
    return findings(v, "o_orderkey").select("o_orderkey", "label")


@register("""SELECT p_name, p_brand, p_type, count(*) - 1 AS surplus FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def view_without_surplus(spark, sf_dir):
    part = without_surplus(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], ["p_partkey"])
    return part.where("surplus").groupBy("p_name", "p_brand", "p_type").agg(F.count("*").alias("surplus"))


@register("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND regexp_full_match(o_orderpriority, '[12]-.*')""")
def scope_filter(spark, sf_dir):
    keep = condition(F.col("o_orderstatus"), ["O", "P"]) & condition(F.col("o_orderpriority"), pattern="[12]-.*")
    return table(spark, sf_dir, "orders").where(keep).select("o_orderkey")
