"""Delimited files and workbooks, with the lineage of every row.

Files are read by Spark's binary source, so they may lie in any store, and each
is parsed in the task that holds it: rows keep their physical line (that of the
record's last line feed is no matter: it is the line where the record begins),
short records are padded and what overflows is kept.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scope import Flow, Scope

# The lineage columns.
LINEAGE = ("source_file", "source_sheet", "source_line", "export_period", "loaded_at", "source_fields", "overflow")
_ROWS = "source_file string, source_sheet string, source_line long, source_fields int, overflow string, header array<string>, cells array<string>"


def parse_text(data: bytes, encoding: str, separator: str, header_line: int = 1):
    """(line, record) of each record, the header first; a byte that can't be decoded is named. Blank lines are skipped."""
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError as e:
        raise ValueError(f"byte {e.start} ({data[e.start]:#04x}) can't be read as {encoding}") from e
    text = text.removeprefix("﻿")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=separator)
    line = 0
    for record in reader:
        first, line = line + 1, reader.line_num
        if first >= header_line and record:
            yield first, record


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def parse_workbook(data: bytes, sheet: str, header_line: int = 1):
    """(line, record) of a sheet's rows, from the package's XML; values only, dates as ISO text, blanks as None."""
    import datetime

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        named = {s.get("name"): links[s.get(_LINK)] for s in book.iter(f"{_MAIN}sheet")}
        if sheet not in named:
            raise ValueError(f"no sheet {sheet!r}; there are {sorted(named)}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dated = set()
        if "xl/styles.xml" in z.namelist():
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            xfs = styles.find(f"{_MAIN}cellXfs")
            for i, x in enumerate(xfs if xfs is not None else ()):
                n = int(x.get("numFmtId", 0))
                if 14 <= n <= 22 or re.search("[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I):
                    dated.add(i)
        target = named[sheet]
        root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        for row in root.iter(f"{_MAIN}row"):
            line, record = int(row.get("r")), []
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match("[A-Z]+", c.get("r"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                record += [None] * (at - 1 - len(record))
                v, kind = c.find(f"{_MAIN}v"), c.get("t", "n")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                elif kind == "n" and int(c.get("s", -1)) in dated:
                    moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(v.text))
                    value = moment.strftime("%Y-%m-%d") if moment.time() == datetime.time() else moment.isoformat(" ", "seconds")
                elif kind == "n" and re.fullmatch(r"-?\d+\.0*", v.text):
                    value = v.text.split(".")[0]
                elif kind == "b":
                    value = "true" if v.text == "1" else "false"
                else:
                    value = v.text
                record.append(value)
            if line >= header_line and any(x is not None for x in record):
                yield line, record


def _parse(flow: Flow):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                records = parse_workbook(data, flow.sheet, flow.header_line) if flow.sheet else parse_text(data, flow.encoding, flow.separator, flow.header_line)
                header, rows = None, []
                for line, record in records:
                    if header is None:
                        header = [x or "" for x in record]
                        continue
                    cells = [*record[: len(header)], *[None] * (len(header) - len(record))]
                    rows.append((line, len(record), (flow.separator or ";").join(x or "" for x in record[len(header) :]) or None, cells))
                    if len(rows) == 5000:
                        yield _batch(path, flow, header, rows)
                        rows = []
                if rows:
                    yield _batch(path, flow, header, rows)

    return run


def _batch(path: str, flow: Flow, header: list[str], rows: list) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([path.rsplit("/", 1)[-1]] * n), pa.array([flow.sheet] * n, pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([header] * n, pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
        names=["source_file", "source_sheet", "source_line", "source_fields", "overflow", "header", "cells"],
    )


def read_table(spark: SparkSession, scope: Scope, table: str, columns: Sequence[str] | None = None, loaded_at: str | None = None) -> DataFrame:
    """A table's files as one: lineage, then its columns by name (those of all headers unless given), as text."""
    files = [(f, p, path) for f, p, path in scope.files if f.table == table]
    if not files:
        raise ValueError(f"no file of {table} is in scope")
    flow = files[0][0]
    raw = spark.read.format("binaryFile").load([path for _, _, path in files]).select("path", "content").mapInArrow(_parse(flow), _ROWS)
    if columns is None:
        columns = sorted({c for r in raw.select("header").distinct().collect() for c in r.header if c})  # one header for each form of file
    period = F.create_map(*[F.lit(x) for _, p, path in files for x in (path.rsplit("/", 1)[-1], p)])
    # Columns without a name are left out; of a name that repeats the first column counts.
    out = raw.withColumn("_m", F.struct("header", "cells"))
    cell = lambda c: F.when(F.array_contains("_m.header", c), F.get("_m.cells", F.array_position("_m.header", c).cast("int") - 1))
    stamp = F.lit(loaded_at).cast("timestamp") if loaded_at else F.date_trunc("second", F.current_timestamp())
    return out.select("source_file", "source_sheet", "source_line", period[F.col("source_file")].alias("export_period"), stamp.alias("loaded_at"), "source_fields", "overflow", *[cell(c).alias(c) for c in columns])


def load_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, source_file, source_sheet, rows)."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("source_file", "source_sheet").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "source_file", "source_sheet", "rows")
        out = part if out is None else out.unionByName(part)
    return out


def lost_rows(summary: DataFrame, counted: DataFrame) -> DataFrame:
    """(source_file, expected, rows, difference) where loaded rows differ from those counted beforehand."""
    n = summary.groupBy("source_file").agg(F.sum("rows").alias("rows"))
    both = counted.select("source_file", F.col("rows").alias("expected")).join(n, "source_file", "full")
    out = both.select("source_file", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("rows", F.lit(0)).alias("rows"))
    return out.withColumn("difference", F.col("rows") - F.col("expected")).where("difference <> 0")


def probe(spark: SparkSession, paths: Sequence[str], encoding: str, separator: str) -> DataFrame:
    """(source_file, sha256, bytes, bom, crlf, lf, decodes, failing_byte, records, widths): what a text file is before it is read."""

    def run(batches):
        kinds = [("source_file", pa.string()), ("bom", pa.bool_()), ("crlf", pa.int64()), ("lf", pa.int64()), ("decodes", pa.bool_()), ("failing_byte", pa.int64()), ("records", pa.int64()), ("widths", pa.string())]
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                crlf = data.count(b"\r\n")
                failing, widths = None, {}
                try:
                    data.decode(encoding)
                except UnicodeDecodeError as e:
                    failing = e.start
                if failing is None:
                    for _, record in parse_text(data, encoding, separator):
                        widths[len(record)] = widths.get(len(record), 0) + 1
                top = sorted(widths.items(), key=lambda x: (-x[1], x[0]))[:4]
                rows.append((path.rsplit("/", 1)[-1], data.startswith(b"\xef\xbb\xbf"), crlf, data.count(b"\n") - crlf, failing is None, failing, sum(widths.values()), ", ".join(f"{w}: {n}" for w, n in top)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    files = spark.read.format("binaryFile").load(list(paths))
    figures = files.select("path", "content").mapInArrow(run, "source_file string, bom boolean, crlf long, lf long, decodes boolean, failing_byte long, records long, widths string")
    marks = files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return marks.join(figures, "source_file")


def header_drift(df: DataFrame) -> DataFrame:
    """From (flow, source_file, header): one row for each form of header, and whether its flow has several."""
    forms = df.groupBy("flow", "header").agg(F.count("*").alias("files"), F.min("source_file").alias("first"))
    many = forms.groupBy("flow").agg((F.count("*") > 1).alias("divergent"))
    return forms.join(many, "flow")
