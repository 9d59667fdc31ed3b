"""Dictionary, decisions, link states, quality mart and report views on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, dictionary, mart, profile
from ..streaming.controls import windowed_counts
from .quality_queries import REGISTER, _register
from .rule_queries import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT * FROM (VALUES ('customer', 'c_mktsegment', 'mandatory', 'mandatory', 'optional', 'reviewed', 'changed'), ('customer', 'c_name', 'mandatory', 'mandatory', 'mandatory', 'proposed', 'added'),
    ('customer', 'c_nationkey', 'mandatory', 'mandatory', 'mandatory', 'proposed', 'followed'), ('customer', 'old', 'mandatory', NULL, 'optional', 'reviewed', 'gone')) t("table", "column", rule, proposal, in_force, status, event)""")
def dictionary_merge(spark, sf_dir):
    found = profile.infer_mandatory(profile.profile(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"]))
    new = found.select(F.lit("customer").alias("table"), "column", F.lit("mandatory").alias("rule"), F.col("rule").alias("proposal"), F.col("rule").alias("in_force"), F.lit("proposed").alias("status"))
    old = spark.createDataFrame([("customer", "c_mktsegment", "mandatory", "optional", "optional", "reviewed"), ("customer", "c_nationkey", "mandatory", "optional", "optional", "proposed"), ("customer", "old", "mandatory", "optional", "optional", "reviewed")], new.schema)
    return dictionary.merge(old, new)


@query("""SELECT 'orders' AS "table", 'o_clerk' AS "column", 'not_loaded' AS problem UNION ALL SELECT 'orders', 'o_custkey', 'not_described'""")
def dictionary_mismatch(spark, sf_dir):
    loaded = spark.createDataFrame([("orders", c) for c in table(spark, sf_dir, "orders").columns], "table string, column string")
    described = loaded.where("column <> 'o_custkey'").union(spark.createDataFrame([("orders", "o_clerk")], "table string, column string"))
    return dictionary.mismatch(described, loaded)


@query("""SELECT DISTINCT c_mktsegment AS value, 'not_listed' AS problem FROM customer WHERE c_mktsegment NOT IN ('BUILDING') UNION ALL SELECT 'NOBODY', 'not_used'""")
def parameter_check(spark, sf_dir):
    return dictionary.parameters(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "NOBODY"])


@query("""
    SELECT o_orderkey, strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d') AS proposal FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE day(o_orderdate) <= 12)
    WHERE month(d) > 6 AND day(d) <= 6""")
def swapped_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    start = F.make_date(F.year("d"), F.lit(1), F.lit(1))
    out = orders.select("o_orderkey", F.date_format(decisions.swapped_date(F.col("d"), start, F.make_date(F.year("d"), F.lit(7), F.lit(1))), "yyyy-MM-dd").alias("proposal"))
    return out.where("proposal IS NOT NULL")


@query(f"""
    WITH r AS ({REGISTER.format(400000)} ) SELECT id, row, 'row' AS kind, CASE WHEN row::BIGINT % 2 = 0 THEN 'stale' ELSE 'none' END AS decision_state FROM r WHERE control = 'shipped' UNION ALL SELECT 'ffffffffffff', NULL, NULL, 'not_found'""")
def arbitration_items(spark, sf_dir):
    r = _register(spark, sf_dir, 400000.0).withColumn("outcome", F.when(F.col("control") == "shipped", "to_arbitrate").otherwise(F.col("outcome"))).withColumn("value", F.lit(None).cast("string"))
    made = r.where("control = 'shipped' AND CAST(row AS BIGINT) % 2 = 0").select("id", F.lit("keep").alias("decision"), F.lit("0").alias("fingerprint"))
    lost = spark.createDataFrame([("ffffffffffff", "keep", "0")], "id string, decision string, fingerprint string")
    return decisions.to_arbitrate(r, made.unionByName(lost)).select("id", "row", "kind", "decision_state")


@query("""SELECT l_orderkey % 10 AS k, CASE WHEN l_orderkey % 10 = 0 THEN 'blank' WHEN l_orderkey % 10 = 1 THEN 'not_found' ELSE 'attached' END AS header_state, count(*) AS rows FROM lineitem GROUP BY 1, 2""")
def link_states(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("head", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey")))
    heads = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 1")
    out = decisions.header_inherits(lines, "head", heads, "o_orderkey", ["o_orderdate"])
    return out.groupBy((F.col("l_orderkey") % 10).alias("k"), "header_state").agg(F.count("*").alias("rows"))


@query("""SELECT 'n' AS "column", count(*) AS cells, count(*) AS "distinct", count(*) AS repairable, count(*) AS repaired_elsewhere FROM nation""")
def encoding_census(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    bad = nation.select(F.concat("n_name", F.lit(" ÃŠ")).alias("n"), F.concat("n_name", F.lit(" Ê")).alias("m"))
    return decisions.suspect_encoding(bad, ["n", "m"])


@query(f"""
    WITH r AS ({REGISTER.format(400000)})
    SELECT row_number() OVER (ORDER BY control) AS control_key, control, count(*) AS findings, count(DISTINCT row) AS rows FROM r GROUP BY control""")
def quality_mart(spark, sf_dir):
    r = _register(spark, sf_dir, 400000.0)
    dim = mart.dimension(r, "control", [], ["control"])
    out = mart.fact(r, {"control_key": ("control", dim)}, ["control", "row"])
    return out.groupBy("control_key", "control").agg(F.count("*").alias("findings"), F.count_distinct("row").alias("rows"))


@query("""
    WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice::DECIMAL(16,4), 2)::DECIMAL(19,2)) AS revenue FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, o_orderdate, revenue FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
    SELECT o_custkey, count(*) AS orders, min(o_orderdate)::DATE::VARCHAR AS first, max(o_orderdate)::DATE::VARCHAR AS last, CASE WHEN bool_and(revenue IS NOT NULL) THEN sum(revenue)::DOUBLE END AS revenue FROM o GROUP BY 1""")
def view_customers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice").cast("decimal(16,4)"), 2).cast("decimal(19,2)")).alias("revenue"))
    out = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey")
    whole = F.when(F.bool_and(F.col("revenue").isNotNull()), F.sum("revenue")).cast("double")
    return out.agg(F.count("*").alias("orders"), F.min("o_orderdate").cast("date").cast("string").alias("first"), F.max("o_orderdate").cast("date").cast("string").alias("last"), whole.alias("revenue"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS "start", event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    """The streaming figures, with the table as one bounded input."""
    out = windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "value")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "rows", F.round("total", 4).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS rows FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def totals_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("rows"))


IPAD, OPAD = (bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(f"""SELECT c_custkey, substr(sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(c_name)))), 1, 16) AS fingerprint FROM customer""")
def keyed_fingerprints(spark, sf_dir):
    """HMAC-SHA-256 of every name, its first 16 hex digits."""
    return table(spark, sf_dir, "customer").select("c_custkey", decisions.keyed_fingerprint(F.col("c_name"), b"key").alias("fingerprint"))
