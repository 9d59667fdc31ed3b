"""Duplicates, profiles, inference, controls, register, cleaning, matching and the star schema on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.cells import comparable, signature
from ..operators import clean, duplicates, mart, profile, register
from ..operators.row_rules import dates_ordered, in_range
from ..operators.verdict import findings
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


NORMAL = "trim(regexp_replace(strip_accents(lower({})), '\\s+', ' ', 'g'))"


@query(f"""
    WITH d AS (SELECT doc_id, {NORMAL.format('text')} AS t, {NORMAL.format('source')} AS s FROM documents), g AS (SELECT t, s, count(*) AS size FROM d GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT doc_id, size FROM d JOIN g USING (t, s)""")
def dup_exact(spark, sf_dir):
    return duplicates.exact(table(spark, sf_dir, "documents"), ["text", "source"]).select("doc_id", "size")


@query("""
    WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS size FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT (l_partkey, l_suppkey, l_extendedprice)) > 1)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS rows, any_value(size) AS size FROM lineitem JOIN g USING (l_orderkey, l_linenumber) GROUP BY 1, 2""")
def dup_value(spark, sf_dir):
    out = duplicates.repeated_value(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return out.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.count("*").alias("rows"), F.max("size").alias("size"))


@query("""
    WITH g AS (SELECT p_name, p_brand, p_type, p_size, count(*) AS size FROM part GROUP BY ALL HAVING count(*) > 1)
    SELECT p_partkey, size FROM part JOIN g USING (p_name, p_brand, p_type, p_size)""")
def dup_except_key(spark, sf_dir):
    return duplicates.except_key(table(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]).select("p_partkey", "size")


@query("""
    WITH l AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS s FROM lineitem GROUP BY 1),
    h AS (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(s, '') AS s FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
    g AS (SELECT o_custkey, o_orderstatus, s, count(*) AS size FROM h GROUP BY 1, 2, 3 HAVING count(*) > 1)
    SELECT o_orderkey, size FROM h JOIN g USING (o_custkey, o_orderstatus, s)""")
def dup_documents(spark, sf_dir):
    out = duplicates.documents_with_equal_lines(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"], table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])
    return out.select("o_orderkey", "size")


@query(f"""
    WITH d AS (SELECT doc_id, {NORMAL.format('text')} AS t FROM documents), m AS (SELECT t, min(doc_id) AS principal FROM d GROUP BY 1)
    SELECT doc_id AS code, principal FROM d JOIN m USING (t) WHERE doc_id <> principal""")
def principal_codes(spark, sf_dir):
    return duplicates.principal_codes(duplicates.exact(table(spark, sf_dir, "documents"), ["text"]), "doc_id", ["doc_id"])


CUSTOMER = ["c_name", "c_mktsegment", "c_nationkey", "c_acctbal"]


@query("""
    WITH c AS (UNPIVOT (SELECT c_name::VARCHAR AS c_name, c_mktsegment::VARCHAR AS c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer) ON c_name, c_mktsegment, c_nationkey INTO NAME "column" VALUE v)
    SELECT "column", count(*) AS rows, 0::BIGINT AS nulls, count(*) AS filled, count(DISTINCT v) AS "distinct", min(length(v)) AS shortest, max(length(v)) AS longest, min(v) AS "first", max(v) AS "last",
           count(DISTINCT regexp_replace(regexp_replace(regexp_replace(v, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g')) AS shapes, CASE WHEN "column" = 'c_nationkey' THEN 'integer' ELSE 'text' END AS nature
    FROM c GROUP BY "column" """)
def profile_columns(spark, sf_dir):
    out = profile.profile(table(spark, sf_dir, "customer"), CUSTOMER[:3])
    return out.select("column", "rows", "nulls", "filled", "distinct", "shortest", "longest", "first", "last", "shapes", "nature")


@query("""SELECT event_type, 'user_id' AS "column", count(*) AS rows, count(DISTINCT user_id) AS "distinct" FROM events GROUP BY 1""")
def profile_by_group(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "events"), ["user_id"], ["event_type"]).select("event_type", "column", "rows", "distinct")


@query("""
    WITH s AS (SELECT regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape, p_brand FROM part)
    SELECT 'p_brand' AS "column", shape, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, min(p_brand) AS example, row_number() OVER (ORDER BY count(*) DESC, shape) AS rank FROM s GROUP BY shape""")
def signatures(spark, sf_dir):
    return profile.shapes(table(spark, sf_dir, "part"), ["p_brand"])


@query("""SELECT 'p_type' AS "column", p_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS rank FROM part GROUP BY p_type""")
def value_frequencies(spark, sf_dir):
    return profile.frequencies(table(spark, sf_dir, "part"), ["p_type"])


@query("""
    SELECT * FROM (VALUES ('c_name', 1.0::DOUBLE, 'mandatory', 'text'), ('c_mktsegment', 1.0, 'mandatory', 'text'), ('c_nationkey', 1.0, 'mandatory', 'integer'), ('odd', NULL, NULL, NULL)) t("column", share, mandatory, nature) WHERE "column" <> 'odd'
    UNION ALL SELECT 'note', round(count(*) FILTER (c_custkey % 50 = 0) / count(*)::DOUBLE, 6), CASE WHEN count(*) FILTER (c_custkey % 50 = 0) / count(*)::DOUBLE <= 0.02 THEN 'always_blank' ELSE 'optional' END, 'undecided' FROM customer""")
def infer_rules(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("note", F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("12"), F.when(F.col("c_custkey") % 100 == 0, "x").otherwise(""))))
    p = profile.profile(customer, [*CUSTOMER[:3], "note"])
    return profile.infer_mandatory(p).select("column", "share", F.col("rule").alias("mandatory")).join(profile.infer_nature(p).select("column", F.col("rule").alias("nature")), "column")


@query("""SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS n, 1.0::DOUBLE AS covered FROM customer GROUP BY 2""")
def infer_closed_list(spark, sf_dir):
    return profile.infer_values(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"])


@query("""
    WITH s AS (SELECT 'c_name' AS "column", regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape FROM customer)
    SELECT "column", shape, count(*) AS n, 1.0::DOUBLE AS covered FROM s GROUP BY 1, 2 HAVING (SELECT count(DISTINCT shape) FROM s) <= 3""")
def infer_shapes(spark, sf_dir):
    return profile.infer_shapes(table(spark, sf_dir, "customer"), ["c_name"])


@query("""SELECT 'o_orderkey' AS "column", count(*) AS rows FROM orders""")
def mine_keys(spark, sf_dir):
    return profile.candidate_keys(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("""
    SELECT 'l_quantity' AS "column", min(l_quantity) AS low, max(l_quantity) AS high, 0::BIGINT AS decimals FROM lineitem
    UNION ALL SELECT 'l_discount', min(l_discount) + 0.0, max(l_discount), 2 FROM lineitem""")
def mine_bounds(spark, sf_dir):
    return profile.observed_bounds(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])


@query("""
    WITH p AS (SELECT 'l_orderkey' AS "left", 'o_orderkey' AS "right", count(DISTINCT l_orderkey) AS d, count(DISTINCT l_orderkey) FILTER (l_orderkey IN (SELECT o_orderkey FROM orders)) AS f FROM lineitem
      UNION ALL SELECT 'l_orderkey', 'o_custkey', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) FILTER (l_orderkey IN (SELECT o_custkey FROM orders)) FROM lineitem
      UNION ALL SELECT 'l_suppkey', 'o_orderkey', count(DISTINCT l_suppkey), count(DISTINCT l_suppkey) FILTER (l_suppkey IN (SELECT o_orderkey FROM orders)) FROM lineitem
      UNION ALL SELECT 'l_suppkey', 'o_custkey', count(DISTINCT l_suppkey), count(DISTINCT l_suppkey) FILTER (l_suppkey IN (SELECT o_custkey FROM orders)) FROM lineitem)
    SELECT "left", "right", f AS found, d AS "distinct" FROM p WHERE f / (d + 1)::DOUBLE >= 0.95""")
def mine_references(spark, sf_dir):
    return profile.inclusions(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])


@query("""SELECT l_returnflag AS by_value, 'ship' AS "column", count(*) AS rows, count(*) AS filled FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def mine_conditional(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("ship", F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")))
    return profile.conditional_presence(lines, "l_returnflag", ["ship"])


@query("""SELECT 'luhn' AS "column", count(*) AS checked, count(*) FILTER ((d1 + d2 + d3) % 10 = 0) AS valid FROM (
    SELECT n % 10 AS d1, CASE WHEN (n // 10) % 10 * 2 > 9 THEN (n // 10) % 10 * 2 - 9 ELSE (n // 10) % 10 * 2 END AS d2, (n // 100) % 10 AS d3 FROM (SELECT c_custkey % 1000 AS n FROM customer))""")
def mine_luhn(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("luhn", F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    return profile.luhn_share(customer, ["luhn"])


@query("""SELECT 'constant' AS "column", 'one_value' AS point UNION ALL SELECT 'never', 'never_filled' UNION ALL SELECT 'spaced', 'odd_spaces'""")
def watch_points(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_name", F.lit("x").alias("constant"), F.lit(None).cast("string").alias("never"), F.concat(F.col("n_name"), F.lit("  ")).alias("spaced"))
    return profile.watch_points(profile.profile(nation, ["n_name", "constant", "never", "spaced"]))


@query("""
    SELECT c_custkey, 'c_mktsegment' AS "column", 'values' AS rule, c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT c_custkey, 'c_name', 'pattern', c_name FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#0*[0-9]*[02468]')
    UNION ALL SELECT c_custkey, 'c_nationkey', 'bounds', c_nationkey::VARCHAR FROM customer WHERE c_nationkey > 20
    UNION ALL SELECT c_custkey, 'code', 'nature', code FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS code FROM customer) WHERE code LIKE 'x%'
    UNION ALL SELECT c_custkey, 'code', 'shapes', code FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS code FROM customer) WHERE NOT regexp_full_match(code, '[0-9]|[0-9][0-9]|[0-9][0-9][0-9]')""")
def control_cells(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("code", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("x"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")))
    rules = {"c_mktsegment": {"mandatory": True, "values": ["BUILDING", "MACHINERY"]}, "c_name": {"pattern": "Customer#0*[0-9]*[02468]"}, "c_nationkey": {"bounds": (0, 20)}, "code": {"nature": "integer", "shapes": ["9", "99", "999"], "spaces": True}}
    return profile.control_cells(customer, ["c_custkey"], rules)


def _register(spark, sf_dir, high: float):
    lines = table(spark, sf_dir, "orders").withColumn("row", F.col("o_orderkey").cast("string"))
    shipped = table(spark, sf_dir, "lineitem").join(lines.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.min("o_orderdate").alias("ordered"))
    return register.unify({"price": ("orders", findings(in_range(lines, "o_totalprice", 1000.0, high), "o_orderkey"), "o_orderkey"), "shipped": ("orders", findings(dates_ordered(shipped, "ordered", "first"), "l_orderkey"), "l_orderkey")})


REGISTER = """
    SELECT substr(sha1(concat_ws(chr(31), control, 'orders', row, label)), 1, 12) AS id, control, row, label, 'anomaly' AS outcome FROM (
        SELECT 'price' AS control, o_orderkey::VARCHAR AS row, CASE WHEN o_totalprice < 1000 THEN 'below_minimum' ELSE 'above_maximum' END AS label FROM orders WHERE o_totalprice < 1000 OR o_totalprice > {}
        UNION ALL SELECT 'shipped', l_orderkey::VARCHAR, 'end_before_start' FROM (SELECT l_orderkey, min(l_shipdate)::DATE AS s, min(o_orderdate)::DATE AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) WHERE s < o)"""


@query(f"""SELECT id, control, row, label, outcome, CASE WHEN control = 'price' THEN 'major' ELSE 'minor' END AS severity, CASE WHEN control = 'price' THEN 'margin,revenue' ELSE '' END AS indicators FROM ({REGISTER.format(400000)})""")
def anomaly_register(spark, sf_dir):
    named = {"price": register.affected(["revenue"], {"margin": ["revenue", "cost"]})}
    out = register.qualify(_register(spark, sf_dir, 400000.0), named)
    return out.select("id", "control", "row", "label", "outcome", "severity", F.array_join("indicators", ",").alias("indicators"))


@query(f"""
    WITH r AS ({REGISTER.format(400000)}), c AS (SELECT 'price' AS control, count(*) AS controlled FROM orders UNION ALL SELECT 'shipped', count(DISTINCT l_orderkey) FROM lineitem)
    SELECT c.control, any_value(controlled) AS controlled, count(id) AS findings, count(DISTINCT row) AS rows_in_anomaly, round(count(DISTINCT row) / any_value(controlled)::DOUBLE, 6) AS rate FROM c LEFT JOIN r USING (control) GROUP BY 1""")
def control_summary(spark, sf_dir):
    n = table(spark, sf_dir, "orders").agg(F.lit("price").alias("control"), F.count("*").alias("controlled")).unionByName(table(spark, sf_dir, "lineitem").agg(F.lit("shipped").alias("control"), F.count_distinct("l_orderkey").alias("controlled")))
    return register.control_summary(_register(spark, sf_dir, 400000.0), n)


@query(f"""
    WITH a AS ({REGISTER.format(300000)}), b AS ({REGISTER.format(400000)})
    SELECT coalesce(a.control, b.control) AS control, count(*) FILTER (b.id IS NULL) AS resolved, count(*) FILTER (a.id IS NULL) AS appeared, 0::BIGINT AS changed, count(*) FILTER (a.id = b.id) AS kept FROM a FULL JOIN b USING (id) GROUP BY 1""")
def before_after(spark, sf_dir):
    return register.compare(_register(spark, sf_dir, 300000.0), _register(spark, sf_dir, 400000.0))


@query(f"""SELECT 'orders' AS source, row FROM ({REGISTER.format(400000)}) WHERE control = 'price' AND label = 'above_maximum'""")
def rows_not_kept(spark, sf_dir):
    r = _register(spark, sf_dir, 400000.0)
    return register.not_kept(r, ["price"], r.where("label = 'below_minimum'").select("id"))


@query("""
    SELECT c_custkey, 'spaces' AS step, 'name' AS "column", '  ' || c_name || '   x ' AS before, c_name || ' x' AS after FROM customer
    UNION ALL SELECT c_custkey, 'replacement', 'segment', c_mktsegment, 'HOUSE' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'""")
def clean_journal(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("   x ")).alias("name"), F.col("c_mktsegment").alias("segment"))
    _, log = clean.journal([clean.spaces_step(["name", "segment"]), clean.replacement_step({"segment": {"HOUSEHOLD": "HOUSE"}})], customer, ["c_custkey"])
    return log


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS read FROM orders""")
def clean_dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "dd.MM.yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MMM yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("iso"), clean.wide_date(text, "2030-01-01").alias("read"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '.50' WHEN 1 THEN p_size || '.50' WHEN 3 THEN p_size || '234.5' END AS read,
    CASE WHEN p_partkey % 6 = 2 THEN 'ambiguous_separator' END AS refusal FROM part""")
def clean_numbers(spark, sf_dir):
    """Decimals with comma and euro sign, with a point, three places (ambiguous), thousands, blanks between single figures, two euro signs."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(n, F.lit(",50 €"))).when(k == 1, F.concat(F.lit(" "), n, F.lit(".50"))).when(k == 2, F.concat(n, F.lit(".500"))).when(k == 3, F.concat(n, F.lit(" 234,5"))).when(k == 4, F.concat(n, F.lit(" 2 3"))).otherwise(F.concat(F.lit("€"), n, F.lit("€")))
    read = clean.read_number(text)
    return table(spark, sf_dir, "part").select("p_partkey", read["value"].alias("read"), read["refusal"].alias("refusal"))


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (2, 5) THEN NULL WHEN event_id % 6 = 3 THEN floor(value)::BIGINT * 60 + 30 ELSE floor(value)::BIGINT END AS minutes FROM events""")
def clean_durations(spark, sf_dir):
    """Hours with minutes, minutes, a time of day (no duration), hours with a decimal, minutes in full, and text."""
    m, k = F.floor("value").cast("int"), F.col("event_id") % 6
    h, r = F.floor(m / 60).cast("int"), m % 60
    text = F.when(k == 0, F.concat(h.cast("string"), F.lit(" h "), r.cast("string"))).when(k == 1, F.concat(m.cast("string"), F.lit(" min"))).when(k == 2, F.concat(h.cast("string"), F.lit(":"), F.lpad(r.cast("string"), 2, "0")))
    text = text.when(k == 3, F.concat(m.cast("string"), F.lit(",5 h"))).when(k == 4, F.concat(m.cast("string"), F.lit(" minutes"))).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "events").select("event_id", clean.wide_duration(text).cast("long").alias("minutes"))


#: Letters with marks, ligatures, wide and circled forms, other scripts and odd blanks, with what their normal form is: fixed values.
LETTERS = [("Straße", "strasse"), ("Łódź", "łodz"), ("č ﬁn", "c fin"), ("Ａbc", "abc"), ("ÉLAN\u00a0 vital", "elan vital"), ("ΣΟΦΟΣ ①", "σοφοσ 1"), ("Привет\u2003Й", "привет и"), ("plain Text", "plain text")]


@query("SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{want}'" for i, (_, want) in enumerate(LETTERS)) + " END || ' ' || c_custkey AS form FROM customer")
def normal_form(spark, sf_dir):
    from ..functions.cells import normalise

    k = F.col("c_custkey")
    said = F.element_at(F.array(*[F.lit(x) for x, _ in LETTERS]), (k % 8).cast("int") + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", normalise(F.concat(F.lit("  "), said, F.lit("\t "), k.cast("string"), F.lit(" "))).alias("form"))


@query("""
    SELECT c_custkey, 'spaces' AS step, 'name' AS "column", '  ' || c_name || ' ' AS before, c_name AS after FROM customer
    UNION ALL SELECT c_custkey, 'replacement', 'segment', c_mktsegment, 'HOUSE' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
    UNION ALL SELECT c_custkey, 'nature', 'price', '12 345,5 €', '12345.5' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'nature', 'day', '01/02/1997', '1997-02-01' FROM customer
    UNION ALL SELECT c_custkey, 'duplicates', NULL, NULL, NULL FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'decisions', NULL, NULL, NULL FROM customer WHERE c_custkey % 7 = 0""")
def clean_steps(spark, sf_dir):
    """The seven steps over a table with odd blanks, values to replace, numbers, dates, copies and decided rows: the journal."""
    k = F.col("c_custkey")
    price = F.when(k % 3 == 0, "12 345,5 €").when(k % 3 == 1, "1.234").otherwise("7")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.col("c_mktsegment").alias("segment"), price.alias("price"), F.lit("01/02/1997").alias("day"), F.lit("a.csv").alias("source_file"))
    rows = rows.unionByName(rows.where(k % 5 == 0).withColumn("source_file", F.lit("b.csv")))
    mark = F.substring(F.sha1(F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))), 1, 16)
    named = F.substring(F.sha1("c_name"), 1, 16)
    decided = table(spark, sf_dir, "customer").where(k % 7 == 0).select(k.alias("key"), F.lit("name").alias("column"), F.lit("remove").alias("decision"), F.lit(None).cast("string").alias("value"), F.coalesce(named, mark).alias("fingerprint"))
    _, log, _ = clean.clean_table(rows.withColumn("row", F.concat_ws("|", k.cast("string"), "source_file")), ["c_custkey", "source_file"], ["c_custkey", "source_file"], spaces=["name", "segment"], replacements={"segment": {"HOUSEHOLD": "HOUSE"}}, natures={"price": ("number", None), "day": ("date", "2000-01-01")}, duplicates=["c_custkey", "name", "segment", "price", "day"], decisions=decided)
    return log.where("source_file = 'a.csv' OR step = 'duplicates'").select("c_custkey", "step", "column", "before", "after")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 40 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS cell, c_mktsegment AS form FROM customer""")
def clean_reference_form(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    dirty = customer.withColumn("cell", F.when(F.col("c_custkey") % 40 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return clean.reference_form(dirty, "cell", customer, "c_mktsegment").select("c_custkey", "cell", F.col("_form").alias("form"))


@query("""SELECT p_name, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2""")
def clean_drop_surplus(spark, sf_dir):
    return clean.drop_surplus(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"], ["p_partkey"])


@query("""SELECT n_name || ' ÃŠ' AS text, n_name || ' Ê' AS repaired FROM nation""")
def clean_encoding(spark, sf_dir):
    return clean.mojibake(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" ÃŠ")).alias("n")), "n")


@query("""
    WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate, l_shipdate, l_linenumber, l_partkey, l_suppkey, (l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY) AS ok FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    n AS (SELECT *, count(*) FILTER (ok) OVER w AS oks, count(*) OVER w AS matches FROM c WINDOW w AS (PARTITION BY o_orderkey)),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN oks = 1 AND ok THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS r FROM n)
    SELECT o_orderkey, matches, l_partkey FROM r WHERE r = 1""")
def match_first_or_by_date(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    inside = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    out = clean.first_match(table(spark, sf_dir, "orders"), "o_orderkey", lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], ["o_orderkey"], inside)
    return out.where("matches > 0").select("o_orderkey", "matches", "l_partkey")


@query("""
    SELECT strftime(d, '%Y%m%d')::BIGINT AS date_key, year(d) AS year, quarter(d) AS quarter, month(d) AS month, day(d) AS day, isodow(d) AS weekday, isodow(d) <= 5 AS is_workday
    FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS d)""")
def dim_date(spark, sf_dir):
    return mart.calendar(spark, 1995, 1998).select("date_key", "year", "quarter", "month", "day", "weekday", "is_workday")


@query("""
    SELECT p_brand, label AS p_name, n FROM (SELECT p_brand, p_name AS label, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY 1, 2) WHERE r = 1""")
def dim_mode_label(spark, sf_dir):
    return mart.most_frequent(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query("""
    SELECT row_number() OVER (ORDER BY c_mktsegment) AS key, c_mktsegment AS code, min(c_custkey) AS c_custkey, count(*) AS rows FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT -1, '(blank)', NULL, NULL UNION ALL SELECT -2, '(not found)', NULL, NULL""")
def dim_segment(spark, sf_dir):
    return mart.dimension(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"], ["c_custkey"])


@query("""
    WITH d AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS key, n_name FROM nation WHERE n_nationkey < 20)
    SELECT nation_key, count(*) AS rows, round(sum(c_acctbal::DECIMAL(28,8))::DOUBLE, 2) AS balance FROM (
        SELECT CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE coalesce(d.key, -2) END AS nation_key, c_acctbal FROM customer JOIN nation n ON c_nationkey = n.n_nationkey LEFT JOIN d ON n.n_name = d.n_name) GROUP BY 1""")
def fact_members(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    dim = mart.dimension(nation.where("n_nationkey < 20"), "n_name", [], ["n_nationkey"])
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("n_name", F.when(F.col("c_custkey") % 11 != 0, F.col("n_name")))
    out = mart.fact(rows, {"nation_key": ("n_name", dim)}, ["c_acctbal"])
    return out.groupBy("nation_key").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("c_acctbal").cast("decimal(28,8)")).cast("double"), 2).alias("balance"))


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    r AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS last_order FROM orders GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, last_order FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.l_shipdate >= r.o_orderdate""")
def asof_rate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_shipdate", "o_custkey")
    rates = orders.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_order"))
    out = mart.as_of(lines, "o_custkey", "l_shipdate", rates, "o_custkey", "o_orderdate", ["last_order"], ["last_order"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "last_order")


@query("""
    WITH RECURSIVE m AS (SELECT l_suppkey AS item, strftime(l_shipdate, '%Y-%m') AS month, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END)::DECIMAL(18,6) AS bought,
        sum(CASE WHEN l_returnflag = 'N' THEN round(l_extendedprice, 2)::DECIMAL(18,6) ELSE 0 END)::DECIMAL(18,6) AS value, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DECIMAL(18,6) AS used FROM lineitem GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY month) AS i FROM m),
    r AS (SELECT item, i, month, 0::DOUBLE AS stock, NULL::DOUBLE AS cost_start, CASE WHEN bought = 0 THEN NULL ELSE round(value::DOUBLE / bought::DOUBLE + 1e-9, 4) END AS cost_end, (bought - used)::DOUBLE AS after FROM n WHERE i = 1
      UNION ALL SELECT n.item, n.i, n.month, r.after, r.cost_end,
        CASE WHEN bought = 0 OR (CASE WHEN r.after > 0 AND r.cost_end IS NOT NULL THEN r.after ELSE 0 END) + bought::DOUBLE <= 0 THEN r.cost_end
             ELSE round(((CASE WHEN r.after > 0 AND r.cost_end IS NOT NULL THEN r.after * r.cost_end ELSE 0 END) + value::DOUBLE) / ((CASE WHEN r.after > 0 AND r.cost_end IS NOT NULL THEN r.after ELSE 0 END) + bought::DOUBLE) + 1e-9, 4) END,
        r.after + (bought - used)::DOUBLE FROM r JOIN n ON n.item = r.item AND n.i = r.i + 1)
    SELECT item, month, round(stock, 2) AS stock, round(cost_end, 1) AS cost_end FROM r""")
def weighted_cost_monthly(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    amount = lambda flag, c: F.sum(F.when(F.col("l_returnflag") == flag, c).otherwise(F.lit(0)))
    months = lines.groupBy(F.col("l_suppkey").alias("item"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        amount("N", F.col("l_quantity").cast("decimal(18,6)")).alias("bought"), amount("N", F.round("l_extendedprice", 2).cast("decimal(18,6)")).alias("value"), amount("R", F.col("l_quantity").cast("decimal(18,6)")).alias("used"))
    out = mart.monthly_costs(months, "item")
    return out.select("item", "month", F.round(F.col("stock").cast("double"), 2).alias("stock"), F.round(F.col("cost_end").cast("double"), 1).alias("cost_end"))


@query("""
    WITH g AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d, count(*) OVER w AS size, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS place, min(o_orderkey) OVER w AS first
        FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate)))
    SELECT o_orderkey, size, place, first FROM g WHERE size > 1""")
def job_grouping(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return mart.jobs(orders, ["o_custkey", "year"], "o_orderkey").select("o_orderkey", "size", "place", "first")


@query("""
    WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice::DECIMAL(16,4), 2)::DECIMAL(19,2)) AS revenue, sum(round(l_extendedprice::DECIMAL(16,4) * l_discount::DECIMAL(10,4), 2)::DECIMAL(19,2)) AS cost FROM lineitem GROUP BY 1)
    SELECT o_orderkey, (revenue - cost)::DOUBLE AS margin, CASE WHEN l_orderkey IS NULL THEN 'no_line' WHEN revenue < 10000 THEN 'small' END AS reason FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def order_margin(spark, sf_dir):
    cents = lambda c: F.sum(F.round(c, 2).cast("decimal(19,2)"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cents(F.col("l_extendedprice").cast("decimal(16,4)")).alias("revenue"), cents(F.col("l_extendedprice").cast("decimal(16,4)") * F.col("l_discount").cast("decimal(10,4)")).alias("cost"))
    out = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    reason = mart.first_reason((F.col("l_orderkey").isNull(), "no_line"), (F.col("revenue") < 10000, "small"))
    return out.select("o_orderkey", mart.margin(F.col("revenue"), F.col("cost")).cast("double").alias("margin"), reason.alias("reason"))


@query("""
    WITH t AS (SELECT 'rows' AS "check", (SELECT count(*) FROM lineitem)::DOUBLE AS expected, (SELECT count(*) FROM lineitem l LEFT JOIN (SELECT DISTINCT l_returnflag AS code FROM lineitem) d ON l.l_returnflag = d.code)::DOUBLE AS obtained
      UNION ALL SELECT 'quantity', (SELECT sum(l_quantity) FROM lineitem), (SELECT sum(q) FROM (SELECT l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1))
      UNION ALL SELECT 'returned', (SELECT sum(l_quantity) FROM lineitem), (SELECT sum(l_quantity) FROM lineitem WHERE l_returnflag = 'R'))
    SELECT *, expected = obtained AS conform FROM t""")
def verify_totals(spark, sf_dir):
    """Two checks that hold and one that doesn't."""
    lines = table(spark, sf_dir, "lineitem")
    dim = mart.dimension(lines, "l_returnflag", [], ["l_returnflag"])
    target = mart.fact(lines, {"flag_key": ("l_returnflag", dim)}, ["l_quantity", "l_returnflag"])
    q = F.sum(F.col("l_quantity").cast("decimal(28,4)"))
    out = mart.hold_totals({"rows": (lines, F.count("*"), target, F.count("*")), "quantity": (lines, q, target, q), "returned": (lines, q, target.where("l_returnflag = 'R'"), q)})
    return out.select("check", F.col("expected").cast("double").alias("expected"), F.col("obtained").cast("double").alias("obtained"), "conform")


@query("""SELECT p_name, count(*) AS n FROM (SELECT list_aggregate(list_sort(string_split(lower(p_name), ' ')), 'string_agg', ' ') AS p_name FROM part) GROUP BY 1""")
def words_in_any_order(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(comparable(F.col("p_name"), "words").alias("p_name")).agg(F.count("*").alias("n"))


@query("""SELECT regexp_replace(regexp_replace(regexp_replace(p_brand || ' é1', '\\p{Lu}', 'A', 'g'), '\\p{Ll}', 'a', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM part GROUP BY 1""")
def shape_function(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(signature(F.concat("p_brand", F.lit(" é1"))).alias("shape")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id, sum(value::DECIMAL(28,8)) OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS running FROM events""")
def running_total(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.sum(F.col("value").cast("decimal(28,8)")).over(w).cast("double").alias("running"))
