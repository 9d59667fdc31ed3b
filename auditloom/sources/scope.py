"""Which files a run reads: flows, periods, expected names, and what is missing, ambiguous or ignored."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Flow:
    """Either ``pattern`` with ``{p}`` for the period, or one ``file``. Text needs encoding and separator, a workbook its sheet."""

    table: str
    pattern: str | None = None
    file: str | None = None
    annual_pattern: str | None = None
    encoding: str | None = None
    separator: str | None = None
    sheet: str | None = None
    header_line: int = 1


@dataclass
class Scope:
    files: list[tuple[Flow, str | None, str]] = field(default_factory=list)  # flow, period, path
    missing: list[str] = field(default_factory=list)
    ambiguous: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)

    def check(self) -> Scope:
        """Raises once, with everything that is wrong."""
        if wrong := [*(f"missing: {x}" for x in self.missing), *(f"ambiguous: {x}" for x in self.ambiguous)]:
            raise ValueError("\n".join(wrong))
        return self


def problems(flows: Sequence[Flow]) -> list[str]:
    out, tables = [], set()
    for f in flows:
        if (f.pattern is None) == (f.file is None):
            out.append(f"{f.table}: give a pattern or a file")
        if f.pattern is not None and "{p}" not in f.pattern:
            out.append(f"{f.table}: the pattern has no {{p}}")
        if f.table in tables:
            out.append(f"{f.table}: declared twice")
        tables.add(f.table)
        book = (f.pattern or f.file or "").lower().endswith(".xlsx")
        if book and not f.sheet:
            out.append(f"{f.table}: a workbook needs a sheet")
        if not book and not (f.encoding and f.separator):
            out.append(f"{f.table}: a text file needs an encoding and a separator")
    return out


def periods(annual: int, end: str, first_month: str | None = None) -> list[str]:
    """The annual period, then every month from ``first_month`` (January of the next year unless given) up to ``end`` (YYYY-MM), over years."""
    first_month = first_month or f"{annual + 1:04d}-01"
    for x in (end, first_month):
        if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", x):
            raise ValueError(f"{x!r} is no period YYYY-MM")
    if end < first_month:
        raise ValueError(f"{end} is before {first_month}")
    month = lambda x: int(x[:4]) * 12 + int(x[5:]) - 1
    return [f"{annual:04d}", *(f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(month(first_month), month(end) + 1))]


def expected(flow: Flow, names: Sequence[str]) -> list[tuple[str | None, str]]:
    """(period, file name) of each file of a flow."""
    if flow.file is not None:
        return [(None, flow.file)]
    return [(p, (flow.annual_pattern if len(p) == 4 and flow.annual_pattern else flow.pattern).replace("{p}", p)) for p in names]


def discover(spark: SparkSession, root: str, flows: Sequence[Flow], names: Sequence[str]) -> Scope:
    """Files below ``root`` by their names, in any folder and any store that Spark reads."""
    if wrong := problems(flows):
        raise ValueError("\n".join(wrong))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").collect()  # names of a run's files, no contents
    by_name: dict[str, list[str]] = {}
    for r in found:
        by_name.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.path)
    scope, used = Scope(), set()
    for flow in flows:
        for period, name in expected(flow, names):
            paths = by_name.get(name, [])
            used.add(name)
            if not paths:
                scope.missing.append(name)
            elif len(paths) > 1:
                scope.ambiguous.append(name)
            else:
                scope.files.append((flow, period, paths[0]))
    scope.ignored = sorted(set(by_name) - used)
    return scope
