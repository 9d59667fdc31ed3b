"""Rule types that compare rows, through ``evaluate`` on tables with copies planted on all sides: the answers are those without copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import row_rules as row
from ..operators.rules import Rule, evaluate
from ..operators.verdict import findings, report, summary
from .rule_queries import LINE, ORACLE as PLAIN
from .rule_queries import SLOTS, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def same_as(name: str):
    """Registers a query whose SQL is that of the query ``name`` on the tables without copies."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = PLAIN[name]
        return f

    return add


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def planted(df: DataFrame, key: str) -> DataFrame:
    """``df`` as of one file, and every fifth key's rows again as of another."""
    again = F.pmod(F.col(key), F.lit(5)) == 0
    return df.withColumn("source_file", F.explode(F.when(again, F.array(F.lit("a.csv"), F.lit("b.csv"))).otherwise(F.array(F.lit("a.csv")))))


def judged(tables: dict[str, tuple[DataFrame, list[str], str]], kind: str, name: str, scope=(), **parameters) -> DataFrame:
    """The verdicts of one rule on the table ``name``; ``tables``: (rows, their key, the column that copies are planted by)."""
    whole = {n: planted(df, by) for n, (df, _, by) in tables.items()}
    order = {n: [*keys, "source_file"] for n, (_, keys, _) in tables.items()}
    return evaluate(whole, [Rule("R", kind, kind, name, parameters, scope)], order)["R"]


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderkey"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem"), [*LINE, "l_extendedprice"], "l_orderkey"


@same_as("rule_header_total")
def view_header_total(spark, sf_dir):
    v = judged({"orders": orders(spark, sf_dir), "lines": lines(spark, sf_dir)}, "total_of_lines", "orders", lines="lines", key="o_orderkey", total="o_totalprice", line_key="l_orderkey", amount="l_extendedprice", tolerance=100000.0)
    return report(v.where("state <> 'surplus'"), "o_orderkey").select("o_orderkey", "state", "label", F.when(F.col("label") == "total_differs", F.col("value").cast("double")).alias("line_total"))


@query("""
    SELECT count(*) + count(*) FILTER (o_orderkey % 5 = 0) AS rows, count(*) FILTER (o_orderkey % 5 = 0) AS surplus, count(*) FILTER (o_orderstatus = 'F') AS out_of_scope, 0::BIGINT AS not_evaluable, count(*) FILTER (o_orderstatus <> 'F') AS controlled FROM orders""")
def view_accounting(spark, sf_dir):
    v = judged({"orders": orders(spark, sf_dir), "lines": lines(spark, sf_dir)}, "total_of_lines", "orders", (("o_orderstatus", ("O", "P"), None),), lines="lines", key="o_orderkey", total="o_totalprice", line_key="l_orderkey", amount="l_extendedprice", tolerance=100000.0)
    return summary(v).select("rows", "surplus", "out_of_scope", "not_evaluable", "controlled")


@same_as("rule_numbering_gaps")
def view_numbering_gaps(spark, sf_dir):
    v = judged({"lines": lines(spark, sf_dir)}, "continuous_numbering", "lines", column="l_linenumber", pattern=r"(\d+)", order=["l_partkey", "l_suppkey", "l_extendedprice"], start=1, keys=["l_orderkey"])
    return findings(v, "l_orderkey", "l_linenumber").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("value").alias("missing"))


@same_as("rule_numbering_chrono")
def view_numbering_chrono(spark, sf_dir):
    v = judged({"orders": orders(spark, sf_dir)}, "chronological_numbering", "orders", column="o_orderkey", pattern=r"(\d+)", date="o_orderdate", order=["o_orderkey"])
    return findings(v, "o_orderkey").select("o_orderkey")


@same_as("rule_overlap")
def view_overlap(spark, sf_dir):
    events = table(spark, sf_dir, "events"), ["event_id"], "event_id"
    v = judged({"events": events}, "no_overlap", "events", group="user_id", start=F.col("ts"), minutes=F.ceil("value").cast("long"), order=["event_id"], gap=5)
    return findings(v, "event_id").select("event_id", "label")


@same_as("rule_group_balance")
def view_group_balance(spark, sf_dir):
    flag = lambda x: F.when(F.col("l_returnflag") == x, F.col("l_quantity")).otherwise(0.0)
    df, keys, by = lines(spark, sf_dir)
    v = judged({"lines": (df.withColumn("debit", flag("R")).withColumn("credit", flag("A")), keys, by)}, "group_balance", "lines", group="l_suppkey", debit="debit", credit="credit", tolerance=100.0)
    found = findings(v, "l_suppkey")
    return found.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.first(F.col("value").cast("double")).alias("difference"))


@same_as("rule_steps_cover")
def view_steps_cover(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    periods = df.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    v = judged({"periods": (periods, ["o_custkey"], "o_custkey"), "steps": (df.where("o_orderstatus = 'F'"), ["o_orderkey"], "o_orderkey")}, "steps_cover", "periods", steps="steps", key="o_custkey", start="a", end="z", step_key="o_custkey", step_date="o_orderdate")
    return findings(v, "o_custkey").select("o_custkey")


@same_as("rule_balance_never_negative")
def view_balance_never_negative(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("q", F.round("value", 2))
    initial = events.select("user_id").distinct().withColumn("initial", F.lit(100))
    exits = events.where("event_type = 'view'").select("event_id", "user_id", "ts", "q")
    tables = {"exits": (exits, ["event_id"], "event_id"), "entries": (events.where("event_type = 'purchase'"), ["event_id"], "event_id"), "initial": (initial, ["user_id"], "user_id")}
    v = judged(tables, "balance_never_negative", "exits", entries="entries", initial="initial", key="user_id", date="ts", quantity="q", order=["event_id"])
    return findings(v, "event_id").select("event_id", "label", "outcome", F.col("value").cast("double").alias("balance"))


@same_as("rule_period_totals")
def view_period_totals(spark, sf_dir):
    year = lambda df, d, x: df.withColumn("period", F.year(d).cast("string")).withColumn("amount", F.col(x))
    a, b = orders(spark, sf_dir), lines(spark, sf_dir)
    v = judged({"orders": (year(a[0], "o_orderdate", "o_totalprice"), *a[1:]), "lines": (year(b[0], "l_shipdate", "l_extendedprice"), *b[1:])}, "period_totals", "orders", right="lines", period="period", amount="amount", tolerance=1000.0)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0)).cast("double"), 2).alias(c)
    return report(v, "period", "left", "right").select("period", zero("left"), zero("right"), "label")


@same_as("rule_unique_link_in_delay")
def view_unique_link_in_delay(spark, sf_dir):
    df, keys, by = lines(spark, sf_dir)
    doc = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("doc")
    documents = df.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("shipped")).select(doc, "l_orderkey", "shipped")
    df = df.withColumn("doc", doc)
    tables = {"orders": orders(spark, sf_dir), "links": (df, keys, by), "documents": (documents, ["doc"], "l_orderkey")}
    v = judged(tables, "unique_link_in_delay", "orders", key="o_orderkey", date="o_orderdate", links="links", link_key="l_orderkey", document="doc", documents="documents", document_key="doc", document_date="shipped", least=0, most=30, cutoff="1998-06-30")
    return findings(v, "o_orderkey").select("o_orderkey", "label", "outcome")


@same_as("rule_reference_conform")
def view_reference_conform(spark, sf_dir):
    customer = table(spark, sf_dir, "customer"), ["c_custkey"], "c_custkey"
    v = judged({"orders": orders(spark, sf_dir), "customer": customer}, "reference_conforms", "orders", key="o_custkey", reference="customer", reference_key="c_custkey", conditions={"c_mktsegment": ["BUILDING", "AUTOMOBILE"]}, exceptions={"c_mktsegment": ["MACHINERY"]})
    return findings(v, "o_orderkey").select("o_orderkey", "outcome")


@same_as("rule_concordance")
def view_concordance(spark, sf_dir):
    df, keys, by = lines(spark, sf_dir)
    df = df.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    tables = {"lines": (df, keys, by), "customer": (table(spark, sf_dir, "customer"), ["c_custkey"], "c_custkey"), "supplier": (table(spark, sf_dir, "supplier"), ["s_suppkey"], "s_suppkey")}
    v = judged(tables, "references_agree", "lines", first=("o_custkey", "customer", "c_custkey", "c_nationkey"), second=("l_suppkey", "supplier", "s_suppkey", "s_nationkey"))
    return findings(v, *LINE).select(*LINE)


@same_as("rule_no_linked")
def view_no_linked(spark, sf_dir):
    df, keys, by = lines(spark, sf_dir)
    v = judged({"orders": orders(spark, sf_dir), "lines": (df.where("l_returnflag = 'R'"), keys, by)}, "no_linked_row", "orders", key="o_orderkey", linked="lines", linked_key="l_orderkey", exception=F.col("l_tax") < 0.05)
    return findings(v, "o_orderkey").select("o_orderkey", F.col("value").cast("long").alias("lines"), "outcome")


@same_as("rule_linked_expected")
def view_linked_expected(spark, sf_dir):
    v = judged({"orders": orders(spark, sf_dir), "lines": lines(spark, sf_dir)}, "linked_row_expected", "orders", key="o_orderkey", linked="lines", linked_key="l_orderkey", conditions={"l_returnflag": ["N"], "l_linestatus": ["O"]})
    return report(v.where("state <> 'surplus'"), "o_orderkey").select("o_orderkey", "state", "label")


@same_as("rule_conform_by_hours")
def view_conform_by_hours(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    tables = {"own": (events.select("event_id", "value"), ["event_id"], "event_id"), "events": (events, ["event_id"], "event_id")}
    v = judged(tables, "conforms_by_hours", "own", key="event_id", reference="events", reference_key="event_id", moment="ts", inside=lambda t: row.inside_hours(t, SLOTS), within=F.col("value") < 50, beyond=F.col("value") >= 20)
    return findings(v, "event_id").select("event_id", "label")


@same_as("rule_quantities_match")
def view_quantities_match(spark, sf_dir):
    df, keys, _ = lines(spark, sf_dir)
    df, keys = df.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey", *keys[1:]]
    tables = {"orders": orders(spark, sf_dir), "a": (df.where("l_returnflag = 'R'"), keys, "o_orderkey"), "b": (df.where("l_returnflag = 'A'"), keys, "o_orderkey")}
    v = judged(tables, "quantities_agree", "orders", key="o_orderkey", a="a", b="b", detail="l_linestatus", quantity="l_quantity", tolerance=20.0)
    return findings(v, "o_orderkey").select("o_orderkey", F.col("value").alias("details"))


@same_as("rule_linked_sum_rounded")
def view_linked_sum_rounded(spark, sf_dir):
    v = judged({"orders": orders(spark, sf_dir), "lines": lines(spark, sf_dir)}, "linked_sum_rounded", "orders", key="o_orderkey", target="o_totalprice", linked="lines", linked_key="l_orderkey", amount="l_quantity", divisor=2000.0, step=10.0, how="up", least=20.0, tolerance=50.0)
    return findings(v, "o_orderkey").select("o_orderkey", F.col("value").cast("double").alias("q"), F.col("proposal").cast("double").alias("expected"))


@same_as("rule_linked_sums")
def view_linked_sums(spark, sf_dir):
    sums = [("o_totalprice", F.col("l_returnflag") == "N", F.col("l_extendedprice"))]
    v = judged({"orders": orders(spark, sf_dir), "lines": lines(spark, sf_dir)}, "linked_sums_agree", "orders", key="o_orderkey", linked="lines", linked_key="l_orderkey", sums=sums, same_date=("o_orderdate", "l_shipdate"), group="l_linestatus", tolerance=150000.0)
    return findings(v, "o_orderkey").select("o_orderkey", "label")


#: Cells of orders as text: every seventh price is no number, every eleventh is blank, every ninth date is no day.
TEXT_CELLS = """
    SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'abc' WHEN o_orderkey % 11 = 0 THEN ' ' ELSE price END AS x, CASE WHEN o_orderkey % 9 = 0 THEN '31/02/1997' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d,
           o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS xr, o_orderkey % 9 <> 0 AS dr FROM (SELECT *, replace((round(o_totalprice, 2)::DECIMAL(18,2))::VARCHAR, '.', ',') AS price, round(o_totalprice, 2)::DECIMAL(18,2)::DOUBLE AS v FROM orders)"""


@query(f"""
    WITH t AS ({TEXT_CELLS}),
    r AS (SELECT 'range' AS rule, CASE WHEN xr THEN 'controlled' ELSE 'not_evaluable' END AS state, CASE WHEN xr AND v > 200000 THEN 'above_maximum' END AS label FROM t
      UNION ALL SELECT 'ratio', CASE WHEN xr THEN 'controlled' ELSE 'not_evaluable' END, NULL FROM t
      UNION ALL SELECT 'sum', CASE WHEN xr THEN 'controlled' ELSE 'not_evaluable' END, NULL FROM t
      UNION ALL SELECT 'product', CASE WHEN xr THEN 'controlled' ELSE 'not_evaluable' END, NULL FROM t
      UNION ALL SELECT 'one', CASE WHEN xr THEN 'controlled' ELSE 'not_evaluable' END, CASE WHEN xr AND round(v, 9) = 0 THEN 'all_zero' END FROM t
      UNION ALL SELECT 'plausible', CASE WHEN dr THEN 'controlled' ELSE 'not_evaluable' END, CASE WHEN dr AND o_orderdate::DATE < DATE '1995-07-01' THEN 'too_early' WHEN dr AND o_orderdate::DATE > DATE '1998-07-01' THEN 'too_late' END FROM t
      UNION ALL SELECT 'ordered', CASE WHEN dr THEN 'controlled' ELSE 'not_evaluable' END, NULL FROM t
      UNION ALL SELECT 'filled', 'controlled', CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN 'missing' END FROM t)
    SELECT rule, state, label, count(*) AS n FROM r GROUP BY ALL""")
def rule_unreadable_cells(spark, sf_dir):
    """Row rules over text cells, some blank and some unreadable, in one scan."""
    from ..operators.rules import evaluate_rows

    k = F.col("o_orderkey")
    price = F.replace(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    text = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, "abc").when(k % 11 == 0, " ").otherwise(price).alias("x"), F.when(k % 9 == 0, "31/02/1997").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"), F.lit("any").alias("kind")
    )
    rule = lambda ref, kind, **p: Rule(ref, ref, kind, "orders", p)
    rules = [
        rule("range", "range", column="x", high=200000.0), rule("ratio", "ratio", numerator="x", denominator="x", low=1.0, high=1.0), rule("sum", "equals_sum", target="x", terms={"x": 1.0}), rule("product", "equals_product", target="x", factors=[{"column": "x"}]),
        rule("one", "at_most_one_non_zero", columns=["x"], at_least_one=True), rule("plausible", "date_plausible", date="d", first="1995-07-01", cutoff="1998-06-01", margin=30), rule("ordered", "dates_ordered", start="d", end="d"), rule("filled", "filled_by_value", column="x", by="kind", values=["any"]),
    ]
    out = evaluate_rows(text, rules, ["o_orderkey"], {"x": "decimal_comma", "d": "date_dmy"})
    return out.groupBy("rule", "state", "label").agg(F.count("*").alias("n"))


@query(f"""
    WITH t AS ({TEXT_CELLS}), s AS (SELECT l_orderkey, sum(round(l_extendedprice, 2)::DECIMAL(28,8)) AS total, bool_or(l_linenumber = 3 AND l_orderkey % 13 = 0) AS bad FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN total IS NULL THEN 'controlled' WHEN xr AND NOT bad THEN 'controlled' ELSE 'not_evaluable' END AS state,
           CASE WHEN total IS NULL THEN 'no_line' WHEN xr AND NOT bad AND abs(round(v - total::DOUBLE, 9)) > 100000 THEN 'total_differs' END AS label FROM t LEFT JOIN s ON o_orderkey = l_orderkey""")
def view_unreadable_totals(spark, sf_dir):
    """Totals against lines, text cells on both sides, copies on both sides."""
    k = F.col("o_orderkey")
    money = lambda c: F.replace(F.round(c, 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    heads = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 7 == 0, "abc").when(k % 11 == 0, " ").otherwise(money("o_totalprice")).alias("x"))
    bad = (F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 13 == 0)
    own = table(spark, sf_dir, "lineitem").withColumn("amount", F.when(bad, "??").otherwise(money("l_extendedprice")))
    whole = {"heads": planted(heads, "o_orderkey"), "lines": planted(own, "l_orderkey")}
    rule = Rule("R", "totals", "total_of_lines", "heads", {"lines": "lines", "key": "o_orderkey", "total": "x", "line_key": "l_orderkey", "amount": "amount", "tolerance": 100000.0})
    v = evaluate(whole, [rule], {"heads": ["o_orderkey", "source_file"], "lines": [*LINE, "l_extendedprice", "source_file"]}, {"heads": {"x": "decimal_comma"}, "lines": {"amount": "decimal_comma"}})["R"]
    return report(v.where("state <> 'surplus'"), "o_orderkey").select("o_orderkey", "state", "label")
