import zipfile
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.functions.cells import blank, nature_of, normalise, read, signature, sql_name, tidy_spaces
from auditloom.operators import clean, duplicates, mart, profile, register
from auditloom.sources.readers import parse_text, parse_workbook, read_table
from auditloom.sources.scope import Flow, discover, periods
from auditloom.sources.sinks import Refused, current, write_all


def column(spark, values, f):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_blank_and_natures(spark):
    assert column(spark, [None, "", " \t ", " ", "x"], blank) == [True, True, True, True, False]
    assert column(spark, ["31/02/2025", "01/02/2025", "20250102", "12", "-1,5", "1.5", "23:59", "24:00"], nature_of) == ["text", "date_dmy", "date_ymd", "integer", "decimal_comma", "decimal_point", "time_hm", "text"]
    assert column(spark, ["31/02/2025", " "], lambda c: read(c, "date_dmy")["state"]) == ["unreadable", "blank"]


def test_signature_and_spaces(spark):
    assert column(spark, ["Ab1-é"], signature) == ["Aa9-a"]
    assert column(spark, ["  a   b ", "a\nb"], tidy_spaces) == ["a b", "a\nb"]


@given(st.text(max_size=20))
def test_sql_name_is_plain_and_stable(name):
    out = sql_name(name)
    assert sql_name(out) == out and all(c.isascii() and (c.isalnum() or c == "_") for c in out)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "Élan", "f1"), (2, "elan", "f2"), (3, "b", "f1"), (4, None, "f1")], "id int, x string, file string")
    assert sorted((r.id, r.size, r.across_files, r.after_normalisation) for r in duplicates.exact(df, ["x"], "file").collect()) == [(1, 2, True, True), (2, 2, True, True)]
    values = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "j", "a"), (4, "j", "a")], "id int, k string, x string")
    assert sorted(r.id for r in duplicates.repeated_value(values, ["k"], ["x"]).collect()) == [1, 2]
    assert sorted(r.id for r in duplicates.except_key(values, ["id"], ["id", "k", "x"]).collect()) == [3, 4]


def test_documents_with_equal_lines(spark):
    heads = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "id int, x string")
    lines = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (2, "p"), (2, "p"), (3, "p")], "id int, y string")
    assert sorted(r.id for r in duplicates.documents_with_equal_lines(heads, "id", ["id", "x"], lines, "id", ["y"]).collect()) == [1, 2]


def test_profile_of_three_blanks(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("12",), ("x",), ("13",)], "x string")
    r = profile.profile(df, ["x"]).first()
    assert (r.rows, r.nulls, r.empty, r.only_spaces, r.filled, r.distinct, r.nature) == (6, 1, 1, 1, 3, 3, "integer")


@pytest.mark.parametrize(
    ("cells", "rule"),
    [
        ([("12", 800), ("abc", 200)], "undecided"), ([("12", 200), ("12x", 200)], "undecided"), ([("12", 100), ("abc", 300)], "undecided"), ([("12", 990), ("abc", 10)], "integer"),
        ([("abc", 996), ("12", 4)], "text"), ([("abc", 30)], "text"), ([("12", 18)], "integer"), ([("12", 17), ("abc", 1)], "undecided"), ([("", 5)], "no_value"),
    ],
)
def test_nature_is_undecided_between_coincidence_and_coverage(spark, cells, rule):
    df = spark.createDataFrame([(v,) for v, n in cells for _ in range(n)], "x string")
    assert profile.infer_nature(profile.profile(df, ["x"])).first().rule == rule


def test_register_ids_are_stable_and_compare(spark):
    found = spark.createDataFrame([("1", "bad", None, "anomaly"), ("2", "bad", "x", "information")], "row string, label string, value string, outcome string")
    a = register.unify({"c": ("t", found, "row")})
    b = register.unify({"c": ("t", found.where("row = '1'"), "row")})
    r = register.compare(a, b).first()
    assert (r.resolved, r.appeared, r.kept) == (1, 0, 1)
    assert register.affected(["x"], {"y": ["x"], "z": ["y"], "w": ["v"]}) == ["x", "y", "z"]
    assert {(r.row, r.severity) for r in register.qualify(a, {"c": ["k"]}).collect()} == {("1", "major"), ("2", None)}


def test_clean_journal_and_decisions(spark):
    df = spark.createDataFrame([(1, " a  b "), (2, "ok"), (3, "wrong")], "id int, x string")
    out, log = clean.journal([clean.spaces_step(["x"])], df, ["id"])
    assert [(r.id, r.before, r.after) for r in log.collect()] == [(1, " a  b ", "a b")]
    mark = df.where("id = 3").select(F.substring(F.sha1("x"), 1, 16).alias("f")).first().f
    decisions = spark.createDataFrame([(3, "x", "correct", "right", mark), (2, "x", "remove", None, "stale")], "key int, column string, decision string, value string, fingerprint string")
    assert sorted((r.id, r.x) for r in clean.apply_decisions(out, "id", decisions).collect()) == [(1, "a b"), (2, "ok"), (3, "right")]


def test_wide_readers(spark):
    said = lambda f: lambda c: F.coalesce(f(c)["refusal"], f(c)["value"].cast("string"))
    dates = ["01.02.2025", "01/02/25", "31/02/2025", "2025-02-01", "20250201", "1.2.2025", "01/02.2025", "01/02/27", "x"]
    assert column(spark, dates, said(lambda c: clean.read_date(c, "2025-12-31"))) == ["2025-02-01", "2025-02-01", "impossible_date", "2025-02-01", "2025-02-01", None, None, "after_cutoff", None]
    assert column(spark, ["01/02/25", "01/02/2025"], said(lambda c: clean.read_date(c, None))) == ["no_cutoff", "2025-02-01"]
    numbers = ["1 234,5", "12 €", "1.234", "1234.567", "1.5", "-3,25€", "1 2 3", "€1€2", "12 345 678", "1 23", "abc"]
    assert column(spark, numbers, said(clean.read_number)) == ["1234.5", "12", "ambiguous_separator", "ambiguous_separator", "1.5", "-3.25", None, None, "12345678", None, None]
    durations = ["1h30", "2 h", "90 min", "1:05", "soon", "1,5 h", "95 minutes", "1 h 10 min", "1h75", "45", "1.5h", "2,5 mn"]
    assert [None if x is None else float(x) for x in column(spark, durations, clean.wide_duration)] == [90, 120, 90, None, None, 90, 95, 70, None, 45, 90, 2.5]
    assert column(spark, ["0,0000001 min"], said(clean.read_duration)) == ["inexact_duration"]


def test_normal_form_is_that_of_unicode(spark):
    import unicodedata

    def want(t):
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold().split())

    texts = ["Straße Łódź č ﬁn Ａ", "ÉLAN\u00a0 vital\u2003x", "İstanbul ſ Σς", "Ⅻ ½ ㎏ 한국", "a\u0301b\u0327", "\x1c tab\tline\n", "", "plain ASCII  Text"]
    assert column(spark, texts, normalise) == [want(t) for t in texts]


def test_seven_cleaning_steps(spark):
    rows = [(1, "Ã‰lan", " 01/02/25", "1 234,5 €", "b"), (2, "elan", "2025-02-01", "1.234", "a"), (3, "Zed", "31/02/2025", "7", "a"), (4, "Zed", "31/02/2025", "7", "a"), (5, "other", None, "x", "a")] + [(10 + i, "Élan", "2025-01-01", "5", f"k{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, name string, day string, price string, code string")
    reference = spark.createDataFrame([("Élan",)], "form string")
    mark = F.substring(F.sha1(F.lit("other")), 1, 16)
    decisions = spark.range(1).select(F.lit(5).alias("key"), F.lit("name").alias("column"), F.lit("remove").alias("decision"), F.lit(None).cast("string").alias("value"), mark.alias("fingerprint"))
    natures = {"day": ("date", "2025-12-31"), "price": ("number", None)}
    out, log, refused = clean.clean_table(df, ["id"], ["id"], ["name"], ["day", "name"], {"name": (reference, "form")}, {"code": {"b": "B"}}, natures, ["name", "day", "price", "code"], decisions)
    first = {r.id: tuple(r)[1:] for r in out.where("id < 10").collect()}
    assert first == {1: ("Élan", "2025-02-01", "1234.5", "B"), 2: ("Élan", "2025-02-01", "1.234", "a"), 3: ("Zed", "31/02/2025", "7", "a")}
    assert sorted((r.id, r.step, r.column) for r in log.collect() if r.id < 10) == [(1, "encoding", "name"), (1, "nature", "day"), (1, "nature", "price"), (1, "replacement", "code"), (1, "spaces", "day"), (2, "reference_form", "name"), (4, "duplicates", None), (5, "decisions", None)]
    assert sorted((r.id, r.column, r.refusal) for r in refused.collect()) == [(2, "price", "ambiguous_separator"), (3, "day", "impossible_date"), (4, "day", "impossible_date"), (5, "price", "unreadable")]


def test_monthly_cost_equals_plain_arithmetic(spark):
    months = [("a", f"2025-{m:02d}", b, v, u) for m, (b, v, u) in enumerate([(10, 100, 4), (0, 0, 3), (5, 80, 20), (7, 33, 1)], 1)]
    stock, cost, expected = Decimal(0), None, []
    for _, _, b, v, u in months:
        held = stock if stock > 0 and cost is not None else Decimal(0)
        after = cost if b == 0 or held + b <= 0 else ((held * (cost or 0) + v) / (held + b)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
        expected.append((stock, cost, after))
        stock, cost = stock + b - u, after
    got = mart.monthly_costs(spark.createDataFrame(months, "item string, month string, bought int, value int, used int"), "item").orderBy("month").collect()
    assert [(r.stock, r.cost_start, r.cost_end) for r in got] == expected


def test_calendar_members_and_as_of(spark):
    assert mart.calendar(spark, 2025, 2027).count() == 1095
    assert "2025-04-21" in mart.french_holidays(2025) and len(mart.french_holidays(2025)) == 11
    dim = mart.dimension(spark.createDataFrame([("b",), ("a",), ("b",)], "c string"), "c", [], ["c"])
    assert sorted((r.key, r.code) for r in dim.collect()) == [(-2, "(not found)"), (-1, "(blank)"), (1, "a"), (2, "b")]
    rows = spark.createDataFrame([("a",), (None,), ("z",)], "c string").withColumn("m", F.lit(1))
    assert sorted(r.k for r in mart.fact(rows, {"k": ("c", dim)}, ["m"]).collect()) == [-2, -1, 1]
    dates = spark.createDataFrame([("k", "2025-01-15"), ("k", "2024-01-01")], "k string, d string")
    rates = spark.createDataFrame([("k", "2025-01-01", 1), ("k", "2025-01-15", 2)], "k string, f string, v int")
    assert sorted((r.d, r.v) for r in mart.as_of(dates, "k", "d", rates, "k", "f", ["v"]).collect()) == [("2024-01-01", None), ("2025-01-15", 2)]


def test_text_source_keeps_lines_overflow_and_order(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/t_2025-01.csv").write_text('a;b\n1;"two\nlines"\n3\n4;5;6\n', encoding="utf-8")
    flow = Flow("t", pattern="t_{p}.csv", encoding="utf-8", separator=";")
    scope = discover(spark, str(tmp_path), [flow], ["2025-01", "2025-02"])
    assert scope.missing == ["t_2025-02.csv"]
    with pytest.raises(ValueError):
        scope.check()
    out = read_table(spark, scope, "t").orderBy("source_line").collect()
    assert [(r.source_line, r.a, r.b, r.source_fields, r.overflow, r.export_period) for r in out] == [(2, "1", "two\nlines", 2, None, "2025-01"), (4, "3", None, 1, None, "2025-01"), (5, "4", "5", 3, "6", "2025-01")]
    with pytest.raises(ValueError, match="byte 0"):
        list(parse_text(b"\xff;a", "utf-8", ";"))
    assert periods(2024, "2025-02") == ["2024", "2025-01", "2025-02"]
    assert periods(2025, "2027-02") == ["2025", *(f"2026-{m:02d}" for m in range(1, 13)), "2027-01", "2027-02"]
    (tmp_path / "y").mkdir()
    (tmp_path / "y/u.csv").write_text("a;;;a\n1;2;3;4\n", encoding="utf-8")
    again = discover(spark, str(tmp_path / "y"), [Flow("u", file="u.csv", encoding="utf-8", separator=";")], [])
    assert [(r.a, r.source_fields) for r in read_table(spark, again, "u").collect()] == [("1", 4)]


def test_workbook(tmp_path):
    path = tmp_path / "b.xlsx"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>d</t></is></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="3"><c r="A3" s="1"><v>45658</v></c><c r="C3"><v>1.5</v></c></row></sheetData></worksheet>')
    assert list(parse_workbook(path.read_bytes(), "S")) == [(1, ["d", None, "n"]), (3, ["2025-01-01", None, "1.5"])]


def test_sink_is_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([("secret", 1.5)], "x string, n double")
    with pytest.raises(Refused):
        write_all({"a": df, "b": df}, str(tmp_path), {"b": ["x"]})
    assert not list(tmp_path.iterdir()) and current(spark, str(tmp_path)) is None
    first = write_all({"a": df, "b": df}, str(tmp_path), form="csv")
    with pytest.raises(Exception, match="ZERO|zero"):
        write_all({"a": df.union(df), "b": df.withColumn("n", F.lit(1) / F.expr("n - n"))}, str(tmp_path), form="csv")
    assert current(spark, str(tmp_path)) == first and {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"CURRENT", first}
    second = write_all({"a": df.union(df), "b": df}, str(tmp_path), form="csv")
    assert current(spark, str(tmp_path)) == second != first
    assert spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/{second}/a").count() == 2


def test_streams(spark, tmp_path):
    from auditloom.operators.rules import Rule
    from auditloom.streaming.controls import landing, register_stream, windowed_counts

    df = spark.createDataFrame([(1, "2025-01-01 00:05:00", 5.0), (2, "2025-01-01 00:15:00", 50.0)], "id int, t string, x double")
    df.write.parquet(f"{tmp_path}/in")
    stream = landing(spark, f"{tmp_path}/in", df.schema)
    register_stream(stream, [Rule("R", "", "range", "t", {"column": "x", "high": 10.0})], ["id"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]
    q = windowed_counts(stream, "t", [], "x").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.rows, r.total) for r in spark.sql("SELECT * FROM w").collect()] == [(2, 55.0)]
