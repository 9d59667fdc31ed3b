"""The driver's contract: queries against their SQL on the small tables."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def plain(v):
    if pd.isna(v):
        return None
    return float(v) if isinstance(v, Number) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", ["rule_header_total", "rule_overlap", "rule_balance_never_negative", "rule_linked_sums", "dup_value", "profile_columns", "anomaly_register", "asof_rate", "weighted_cost_monthly", "view_header_total", "view_numbering_gaps", "view_unreadable_totals", "rule_unreadable_cells", "clean_numbers", "clean_durations", "clean_steps", "normal_form", "keyed_fingerprints", "verify_totals"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda d: sorted((tuple(plain(v) for v in r) for r in d[columns].itertuples(index=False)), key=str)
    assert tidy(got) == tidy(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["rule_overlap", "view_overlap"])
def test_gap_at_its_bound_equals_the_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-08 12:00:00.44' + to_microseconds(i // 100 * 60000000 + i // 100 * (299000000 + (i % 100) * 20000)) AS ts, i % 100 AS user_id, 'view' AS event_type, 0.5::DOUBLE AS value, '{}' AS props FROM range(200) t(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {(r.event_id, r.label) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(entry.oracle_sql()[name]).fetchall()) and 0 < len(got) < 100
