"""The catalogue of rule types, rule instances, and the driver that evaluates many of them.

Rules of one table that look at a row alone are evaluated in one pass over it;
the others are a plan each. Nothing runs until a result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linked_rules as linked
from . import row_rules as row
from . import sequence_rules as seq
from ..functions.cells import read
from ..sources.readers import LINEAGE
from .verdict import ANOMALY, ARBITRATE, CONTROLLED, FINDING, INFORMATION, OUT_OF_SCOPE, SURPLUS, condition, first_copies, raw, without_surplus

ALL_ROWS, NO_SURPLUS = "all", "without_surplus"


@dataclass(frozen=True)
class RuleType:
    """``tables``: parameters that name other tables; ``required``: parameters without default."""

    function: Callable[..., DataFrame]
    view: str
    outcome: str
    required: tuple[str, ...]
    tables: tuple[str, ...] = ()
    row_local: bool = False


def _row(f, *required: str, outcome: str = ANOMALY) -> RuleType:
    return RuleType(f, ALL_ROWS, outcome, required, (), True)


TYPES: dict[str, RuleType] = {
    "date_in_period": _row(row.date_in_period, "date", "period", outcome=ARBITRATE),
    "range": _row(row.in_range, "column"),
    "range_by_value": _row(row.range_by_value, "column", "by", "ranges"),
    "ratio": _row(row.ratio_in_range, "numerator", "denominator", "low", "high"),
    "continuous_numbering": RuleType(seq.continuous_numbering, NO_SURPLUS, ANOMALY, ("column", "pattern", "order")),
    "chronological_numbering": RuleType(seq.chronological_numbering, NO_SURPLUS, ARBITRATE, ("column", "pattern", "date", "order")),
    "no_overlap": RuleType(seq.no_overlap, NO_SURPLUS, ANOMALY, ("group", "start", "minutes", "order")),
    "outside_hours": _row(row.outside_hours, "moment", "by", "values", "slots"),
    "equals_sum": _row(row.equals_sum, "target", "terms"),
    "total_of_lines": RuleType(linked.total_of_lines, NO_SURPLUS, ANOMALY, ("lines", "key", "total", "line_key", "amount"), ("lines",)),
    "group_balance": RuleType(seq.group_balance, NO_SURPLUS, ANOMALY, ("group", "debit", "credit")),
    "exists_in": RuleType(linked.exists_in, ALL_ROWS, ANOMALY, ("key", "reference", "reference_key"), ("reference",)),
    "date_in_reference_period": RuleType(linked.date_in_reference_period, ALL_ROWS, ANOMALY, ("key", "date", "reference", "reference_key", "start", "end"), ("reference",)),
    "steps_cover": RuleType(seq.steps_cover, NO_SURPLUS, ANOMALY, ("steps", "key", "start", "end", "step_key", "step_date"), ("steps",)),
    "year_in_reference": RuleType(linked.year_in_reference, ALL_ROWS, ANOMALY, ("date", "reference", "year"), ("reference",)),
    "unique_link_in_delay": RuleType(linked.unique_link_in_delay, NO_SURPLUS, ANOMALY, ("key", "date", "links", "link_key", "document", "documents", "document_key", "document_date", "least", "most", "cutoff"), ("links", "documents")),
    "reference_conforms": RuleType(linked.reference_conforms, NO_SURPLUS, ANOMALY, ("key", "reference", "reference_key", "conditions"), ("reference",)),
    "references_agree": RuleType(linked.references_agree, NO_SURPLUS, ANOMALY, ("first", "second")),
    "no_linked_row": RuleType(linked.no_linked_row, NO_SURPLUS, ANOMALY, ("key", "linked", "linked_key"), ("linked",)),
    "linked_row_expected": RuleType(linked.linked_row_expected, NO_SURPLUS, ANOMALY, ("key", "linked", "linked_key", "conditions"), ("linked",)),
    "conforms_by_hours": RuleType(linked.conforms_by_hours, NO_SURPLUS, ANOMALY, ("key", "reference", "reference_key", "moment", "inside", "within", "beyond"), ("reference",)),
    "quantities_agree": RuleType(linked.quantities_agree, NO_SURPLUS, ANOMALY, ("key", "a", "b", "detail", "quantity"), ("a", "b")),
    "equals_product": _row(row.equals_product, "target", "factors"),
    "linked_sum_rounded": RuleType(linked.linked_sum_rounded, NO_SURPLUS, ANOMALY, ("key", "target", "linked", "linked_key", "amount", "divisor", "step"), ("linked",)),
    "at_most_one_non_zero": _row(row.at_most_one_non_zero, "columns"),
    "linked_sums_agree": RuleType(linked.linked_sums_agree, NO_SURPLUS, ANOMALY, ("key", "linked", "linked_key", "sums"), ("linked",)),
    "period_totals": RuleType(seq.period_totals, NO_SURPLUS, ANOMALY, ("right", "period", "amount"), ("right",)),
    "filled_by_value": _row(row.filled_by_value, "column", "by", "values"),
    "balance_never_negative": RuleType(seq.balance_never_negative, NO_SURPLUS, ANOMALY, ("entries", "initial", "key", "date", "quantity", "order"), ("entries", "initial")),
    "dates_ordered": _row(row.dates_ordered, "start", "end"),
    "date_plausible": _row(row.date_plausible, "date", "first", "cutoff", outcome=ARBITRATE),
}


@dataclass(frozen=True)
class Rule:
    """``scope``: (column, values or None, pattern or None), all of which must hold; ``outcome`` overrides the type's."""

    ref: str
    label: str
    type: str
    table: str
    parameters: Mapping = field(default_factory=dict)
    scope: Sequence[tuple[str, Sequence | None, str | None]] = ()
    outcome: str | None = None


class RuleErrors(ValueError):
    """Everything that is wrong with a set of rules, found at once."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("\n".join(problems))
        self.problems = list(problems)


def problems(rules: Sequence[Rule], tables: Mapping[str, DataFrame]) -> list[str]:
    out, refs, seen = [], set(), {}
    for r in rules:
        if r.ref in refs:
            out.append(f"{r.ref}: the reference is used twice")
        refs.add(r.ref)
        if r.type not in TYPES:
            out.append(f"{r.ref}: no rule type {r.type}")
            continue
        kind = TYPES[r.type]
        out += [f"{r.ref}: {p} is missing" for p in kind.required if p not in r.parameters]
        out += [f"{r.ref}: no table {n}" for n in [r.table, *_linked(r.parameters, kind)] if n not in tables]
        if r.outcome not in (None, ANOMALY, ARBITRATE, INFORMATION):
            out.append(f"{r.ref}: no outcome {r.outcome}")
        if r.table in tables:
            columns = set(tables[r.table].columns)
            named = [v for k, v in r.parameters.items() if k in ("column", "key", "date", "target", "total", "numerator", "denominator", "by", "group", "debit", "credit") and isinstance(v, str) and not (k == "group" and r.type == "linked_sums_agree")]
            out += [f"{r.ref}: {r.table} has no column {c}" for c in dict.fromkeys([*named, *(c for c, _, _ in r.scope)]) if c not in columns]
        same = (r.type, r.table, repr(sorted(r.parameters.items(), key=lambda x: x[0])), repr(r.scope))
        if same in seen:
            out.append(f"{r.ref}: the same as {seen[same]}")
        seen.setdefault(same, r.ref)
    return out


#: Types that refuse keys which stand more than once in the view, by the parameter that names the key.
UNIQUE_KEY = frozenset("total_of_lines unique_link_in_delay quantities_agree linked_sum_rounded linked_sums_agree".split())


def typed(df: DataFrame, natures: Mapping[str, str]) -> DataFrame:
    """``df`` with the columns of ``natures`` read (null where unreadable) and the cells as loaded beside them."""
    named = {c: n for c, n in natures.items() if c in df.columns}
    return df.withColumns({f"__raw_{c}": F.col(c) for c in named}).withColumns({c: read(F.col(c), n)["value"] for c, n in named.items()})


def _untyped(v: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The cells as loaded, where ``v`` holds them."""
    return v.select(*[F.col(f"__raw_{c}").alias(c) if f"__raw_{c}" in v.columns else F.col(c) for c in columns], "state", "findings")


def _linked(parameters: Mapping, kind: RuleType) -> list[str]:
    """The names of the other tables of a rule, also those of its lookups."""
    named = [parameters[p] for p in kind.tables if isinstance(parameters.get(p), str)]
    return named + [v[1] for v in parameters.values() if isinstance(v, tuple) and len(v) == 4 and isinstance(v[1], str)]


def evaluate(tables: Mapping[str, DataFrame], rules: Sequence[Rule], order: Mapping[str, Sequence[str]] | None = None, natures: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, DataFrame]:
    """Each rule's verdicts by its reference.

    ``natures``: how the columns of each table are read; a cell that can't be
    makes its row not evaluable. Types that compare rows work on the view
    without surplus duplicates (data columns only, whatever their lineage): their
    own table and the linked ones; ``order`` must give a total order of
    each. Rows of the rule's table outside its scope, and its surplus ones, come
    back as such and are counted; how often a key stands is counted before the
    scope is applied. Cells come back as they were loaded.
    """
    order, natures = order or {}, natures or {}
    found = problems(rules, tables)
    for r in rules:
        if r.type in TYPES and TYPES[r.type].view == NO_SURPLUS:
            found += [f"{r.ref}: no total order of {t} is given" for t in dict.fromkeys([r.table, *_linked(r.parameters, TYPES[r.type])]) if t in tables and t not in order]
    if found:
        raise RuleErrors(found)
    data = lambda name: [c for c in tables[name].columns if c not in LINEAGE]
    firsts = {n: first_copies(tables[n], data(n), order[n]) for n in tables if n in order}

    def given(name: str, kind: RuleType) -> DataFrame:
        return typed(firsts[name] if kind.view == NO_SURPLUS else tables[name], natures.get(name, {}))

    out = {}
    for r in rules:
        kind, own = TYPES[r.type], list(tables[r.table].columns)
        keep = F.lit(True)
        for column, values, pattern in r.scope:
            keep = keep & condition(F.col(column), values, pattern)
        set_aside = []
        df = tables[r.table]
        if kind.view == NO_SURPLUS:
            set_aside.append(_aside(without_surplus(tables[r.table], data(r.table), order[r.table]).where("surplus").select(*own), SURPLUS))
            df = firsts[r.table]
        if r.type in UNIQUE_KEY and r.scope:
            key = r.parameters["key"]
            df = df.join(df.groupBy(key).agg(F.count("*").alias("__times")), key, "left")
        if r.scope:
            set_aside.append(_aside(df.where(~keep).select(*own), OUT_OF_SCOPE))
            df = df.where(keep)
        df = typed(df, natures.get(r.table, {}))
        parameters = {k: given(v, kind) if k in kind.tables and isinstance(v, str) else v for k, v in r.parameters.items()}
        parameters = {k: (v[0], given(v[1], kind), *v[2:]) if isinstance(v, tuple) and len(v) == 4 and isinstance(v[1], str) else v for k, v in parameters.items()}
        v = kind.function(df, **parameters, outcome=r.outcome or kind.outcome)
        if r.type == "period_totals":  # a row for each period, not for each row of the table
            out[r.ref] = v
            continue
        v = _untyped(v, own)
        for x in set_aside:
            v = v.unionByName(x)
        out[r.ref] = v
    return out


def _aside(df: DataFrame, state: str) -> DataFrame:
    return df.withColumn("state", F.lit(state)).withColumn("findings", F.array().cast(FINDING))


def evaluate_rows(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], natures: Mapping[str, str] | None = None) -> DataFrame:
    """All row-local rules of one table in one scan: keys, rule, state, label, value, proposal, outcome; rows without finding have none."""
    wide = typed(df, natures or {})
    for r in rules:
        kind = TYPES[r.type]
        if not kind.row_local:
            raise ValueError(f"{r.ref} looks at more than its row")
        keep = F.lit(True)
        for column, values, pattern in r.scope:
            keep = keep & condition(raw(wide, column), values, pattern)
        wide = kind.function(wide, **r.parameters, outcome=r.outcome or kind.outcome)
        state = F.when(keep, F.col("state")).otherwise(OUT_OF_SCOPE)
        wide = wide.withColumn(f"_rule_{r.ref}", F.struct(F.lit(r.ref).alias("rule"), state.alias("state"), F.when(state == CONTROLLED, F.col("findings")).otherwise(F.array()).alias("findings"))).drop("state", "findings")
    rows = wide.select(*keys, F.explode(F.array(*[F.col(f"_rule_{r.ref}") for r in rules])).alias("v"))
    return rows.select(*keys, "v.rule", "v.state", F.explode_outer("v.findings").alias("f")).select(*keys, "rule", "state", "f.label", "f.value", "f.proposal", "f.outcome")
