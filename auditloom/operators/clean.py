"""Cleaning what can be corrected without doubt, with a journal of every changed cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import blank, comparable, tidy_spaces


#: The blanks that may stand between thousands and before units.
GAP = "[ \u00a0\u202f]"


def _said(value: Column, *refusals: tuple[Column, str]) -> Column:
    """struct(value, refusal): the first refusal whose condition holds, else the value."""
    why = F.lit(None).cast("string")
    for when, name in reversed(refusals):
        why = F.when(F.coalesce(when, F.lit(False)), name).otherwise(why)
    return F.struct(F.when(why.isNull(), value).alias("value"), why.alias("refusal"))


def read_date(c: Column, cutoff: str | None) -> Column:
    """struct(value, refusal): ISO text of ``dd/mm/yyyy`` (one of ``/ . -``, twice), ``yyyy-mm-dd``, ``yyyymmdd`` and ``dd/mm/yy``.

    Two-figure years are 20xx, up to the cut-off. Refusals: impossible_date,
    no_cutoff, after_cutoff. Other texts have neither value nor refusal.
    """
    t = F.trim(c.cast("string"))
    form = F.regexp_replace(t, r"^(\d{2})([/.\-])(\d{2})\2(\d{2}|\d{4})\z", "$1/$3/$4")
    read = lambda x, f: F.try_to_timestamp(x, F.lit(f)).cast("date")
    long, iso, plain, short = form.rlike(r"^\d{2}/\d{2}/\d{4}\z"), t.rlike(r"^\d{4}-\d{2}-\d{2}\z"), t.rlike(r"^\d{8}\z"), form.rlike(r"^\d{2}/\d{2}/\d{2}\z")
    date = F.when(long, read(form, "dd/MM/yyyy")).when(iso, read(t, "yyyy-MM-dd")).when(plain, read(t, "yyyyMMdd")).when(short, read(F.concat(F.substring(form, 1, 6), F.lit("20"), F.substring(form, 7, 2)), "dd/MM/yyyy"))
    late = date > F.lit(cutoff).cast("date")
    return _said(F.date_format(date, "yyyy-MM-dd"), ((long | iso | plain | short) & date.isNull(), "impossible_date"), (short & F.lit(cutoff is None), "no_cutoff"), (short & late, "after_cutoff"))


def read_number(c: Column) -> Column:
    """struct(value, refusal): plain text of whole numbers, of decimals with comma or point, and of thousands set apart by blanks; a euro sign may end it.

    Refusal: ambiguous_separator, for three places after a point.
    """
    t = F.regexp_replace(F.trim(c.cast("string")), f"{GAP}?€\\z", "")
    ambiguous = t.rlike(r"^-?\d+\.\d{3}\z")
    plain = t.rlike(r"^-?\d+([.,]\d+)?\z") | t.rlike(f"^-?\\d{{1,3}}({GAP}\\d{{3}})+(,\\d+)?\\z")
    return _said(F.when(plain, F.replace(F.regexp_replace(t, GAP, ""), F.lit(","), F.lit("."))), (ambiguous, "ambiguous_separator"))


def read_duration(c: Column) -> Column:
    """struct(value, refusal): minutes, a decimal, of ``95 min`` (mn, minutes), ``2 h`` and ``1,5 h`` (heures), ``1h10`` (``1 h 10 min``) or a whole number of minutes.

    ``1:10`` is a time of day and no duration. Refusal: inexact_duration, for
    more than six places.
    """
    t = F.lower(F.trim(c.cast("string")))
    both = f"^(\\d+){GAP}?h{GAP}?(\\d{{1,2}})({GAP}?(?:min|mn|minutes?))?\\z"
    minutes, hours, whole = f"^(\\d+(?:[.,]\\d+)?){GAP}?(?:min|mn|minutes?)\\z", f"^(\\d+(?:[.,]\\d+)?){GAP}?(?:h|heures?)\\z", r"^\d+\z"
    part = lambda p, g: F.replace(F.regexp_extract(t, p, g), F.lit(","), F.lit(".")).try_cast("decimal(38,12)")
    rest = part(both, 2)
    value = F.when(t.rlike(both), F.when(rest <= 59, part(both, 1) * 60 + rest)).when(t.rlike(minutes), part(minutes, 1)).when(t.rlike(hours), part(hours, 1) * 60).when(t.rlike(whole), t.try_cast("decimal(38,12)"))
    short = value.cast("decimal(28,6)")
    return _said(short, (value != short, "inexact_duration"))


def wide_date(c: Column, cutoff: str | None) -> Column:
    """The value of ``read_date``."""
    return read_date(c, cutoff)["value"]


def wide_number(c: Column) -> Column:
    """The value of ``read_number``."""
    return read_number(c)["value"]


def wide_duration(c: Column) -> Column:
    """The value of ``read_duration``."""
    return read_duration(c)["value"]


def reference_form(df: DataFrame, column: str, reference: DataFrame, reference_column: str, least: float = 0.95) -> Column | DataFrame:
    """``df`` with ``_form``: the one form in the reference that equals the cell after normalisation, where the rows in their right form reach ``least``."""
    forms = reference.where(~blank(F.col(reference_column))).select(F.col(reference_column).cast("string").alias("_f")).distinct()
    one = forms.groupBy(comparable(F.col("_f"), "normalised").alias("_k")).agg(F.min("_f").alias("_form"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    out = df.withColumn("_k", comparable(F.col(column), "normalised")).join(one, "_k", "left")
    share = out.agg((F.count_if(F.col(column) == F.col("_form")) / (F.count_if(F.col("_form").isNotNull()) + 1)).alias("_share"))  # one row
    return out.crossJoin(F.broadcast(share)).withColumn("_form", F.when(F.col("_share") >= least, F.col("_form"))).drop("_k", "_share")


def journal(steps: Sequence[tuple[str, Mapping[str, Column]]], df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(cleaned, journal): steps in order, each sees the last one's cells; a null means no change.

    journal: keys..., step, column, before, after; one row for each changed cell.
    """
    out, changes = df, []
    for step, columns in steps:
        for c, new in columns.items():
            mark = f"_j{len(changes)}"
            after = F.coalesce(new, F.col(c))
            out = out.withColumn(mark, F.when(~after.eqNullSafe(F.col(c)), F.struct(F.lit(step).alias("step"), F.lit(c).alias("column"), F.col(c).cast("string").alias("before"), after.cast("string").alias("after"))))
            out = out.withColumn(c, F.coalesce(F.col(f"{mark}.after"), F.col(c)))
            changes.append(mark)
    if not changes:
        return df, df.select(*keys, *[F.lit(None).cast("string").alias(x) for x in ("step", "column", "before", "after")]).limit(0)
    log = out.select(*keys, F.explode(F.array_compact(F.array(*changes))).alias("j")).select(*keys, "j.step", "j.column", "j.before", "j.after")
    return out.drop(*changes), log


def spaces_step(columns: Sequence[str]) -> tuple[str, dict[str, Column]]:
    return "spaces", {c: tidy_spaces(F.col(c)) for c in columns}


def replacement_step(replacements: Mapping[str, Mapping[str, str]]) -> tuple[str, dict[str, Column]]:
    """Invalid values with a decided replacement, by column."""
    return "replacement", {c: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)] for c, m in replacements.items() if m}


def drop_surplus(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first of rows that are equal after normalisation."""
    from .verdict import without_surplus

    return without_surplus(df, columns, order).where("NOT surplus").drop("surplus")


def apply_decisions(df: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """Corrections then removals by key: (key, column, decision, value, fingerprint); a stale one (SHA-1 of the cell, 16 hex) does nothing."""
    text = [c for c, t in df.dtypes if t == "string"]
    d = decisions.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("column", "decision", "value", "fingerprint")).alias("_d"))
    out = df.join(d, key, "left")
    mine = lambda c, what: F.filter("_d", lambda x: (x["column"] == c) & (x["decision"] == what) & (x["fingerprint"] == F.substring(F.sha1(F.coalesce(F.col(c), F.lit(""))), 1, 16)))
    gone = F.lit(False)
    for c in text:
        gone = gone | (F.coalesce(F.size(mine(c, "remove")), F.lit(0)) > 0)
    out = out.where(~F.coalesce(gone, F.lit(False)))
    return out.withColumns({c: F.when(F.size(mine(c, "correct")) == 1, F.element_at(mine(c, "correct"), 1)["value"]).otherwise(F.col(c)) for c in text}).select(*df.columns)


def natures_step(natures: Mapping[str, tuple[str, str | None]]) -> tuple[str, dict[str, Column]]:
    """Cells written as their column's nature, date, number or duration, by (nature, cut-off); what is refused stays as it is."""
    readers = {"date": lambda c, cutoff: wide_date(c, cutoff), "number": lambda c, _: wide_number(c), "duration": lambda c, _: F.regexp_replace(wide_duration(c).cast("string"), r"\.?0+\z", "")}
    return "nature", {c: readers[n](F.col(c), cutoff) for c, (n, cutoff) in natures.items()}


def refusals(df: DataFrame, natures: Mapping[str, tuple[str, str | None]], keys: Sequence[str]) -> DataFrame:
    """(keys..., column, value, refusal) of filled cells that can't be written as their nature; ``unreadable`` for forms of no kind."""
    readers = {"date": lambda c, cutoff: read_date(c, cutoff), "number": lambda c, _: read_number(c), "duration": lambda c, _: read_duration(c)}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), readers[n](F.col(c), cutoff).alias("r")) for c, (n, cutoff) in natures.items()])
    rows = df.select(*keys, F.explode(cells).alias("x")).where(~blank(F.col("x.value")) & F.col("x.r.value").isNull())
    return rows.select(*keys, "x.column", "x.value", F.coalesce("x.r.refusal", F.lit("unreadable")).alias("refusal"))


def clean_table(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    encoded: Sequence[str] = (),
    spaces: Sequence[str] = (),
    forms: Mapping[str, tuple[DataFrame, str]] | None = None,
    replacements: Mapping[str, Mapping[str, str]] | None = None,
    natures: Mapping[str, tuple[str, str | None]] | None = None,
    duplicates: Sequence[str] = (),
    decisions: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned, journal, refused) after the seven steps in their order: encoding, spaces, reference form, replacement, nature, duplicates, decisions.

    Each step sees the cells as the last one left them. journal: keys..., step,
    column, before, after for each changed cell, and a row without column for
    each row that the last two steps take away. refused: what ``refusals`` gives.
    ``keys`` name a row in the journal; the first of them is what ``decisions``
    name. ``order`` tells which of equal rows is first.
    """
    out, logs = df, []
    for c in encoded:
        fixed = mojibake(out, c).select(F.col("text").alias("__text"), F.col("repaired").alias("__fixed"))
        joined = out.join(fixed, F.col(c) == F.col("__text"), "left")
        out, log = journal([("encoding", {c: F.col("__fixed")})], joined, keys)
        out = out.select(*df.columns)
        logs.append(log)
    steps = [spaces_step(spaces)]
    out, log = journal(steps, out, keys)
    logs.append(log)
    for c, (reference, column) in (forms or {}).items():
        out, log = journal([("reference_form", {c: F.col("_form")})], reference_form(out, c, reference, column), keys)
        out = out.select(*df.columns)
        logs.append(log)
    refused = refusals(replaced(out, replacements or {}), natures, keys) if natures else None
    out, log = journal([replacement_step(replacements or {}), natures_step(natures or {})], out, keys)
    logs.append(log)
    gone = lambda rows, step: rows.select(*keys, F.lit(step).alias("step"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    if duplicates:
        from .verdict import without_surplus

        marked = without_surplus(out, duplicates, order)
        logs.append(gone(marked.where("surplus"), "duplicates"))
        out = marked.where("NOT surplus").select(*df.columns)
    if decisions is not None:
        after = apply_decisions(out, keys[0], decisions)
        logs.append(gone(out.join(after.select(*keys), list(keys), "left_anti"), "decisions"))
        text = [c for c, t in df.dtypes if t == "string" and c not in keys]
        both = out.join(after.select(*keys, F.struct(*[F.col(c).alias(c) for c in text]).alias("__new")), list(keys))
        _, log = journal([("decisions", {c: F.col(f"__new.{c}") for c in text})], both, keys)
        logs.append(log)
        out = after
    whole = logs[0]
    for x in logs[1:]:
        whole = whole.unionByName(x)
    return out, whole, refused if refused is not None else whole.select(*keys, "column", F.col("before").alias("value"), F.lit(None).cast("string").alias("refusal")).limit(0)


def replaced(df: DataFrame, replacements: Mapping[str, Mapping[str, str]]) -> DataFrame:
    return df.withColumns({c: F.coalesce(new, F.col(c)) for c, new in replacement_step(replacements)[1].items()})


def mojibake(df: DataFrame, column: str) -> DataFrame:
    """(text, repaired): distinct texts of the column that read as UTF-8 decoded as Windows-1252, and what they were.

    Only distinct texts with a suspect sign go through Python, in Arrow batches.
    """
    import pyarrow as pa

    def repair(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                fixed = t
                for _ in range(5):
                    try:
                        fixed = fixed.encode("cp1252").decode("utf-8")
                    except (UnicodeEncodeError, UnicodeDecodeError):
                        break
                out.append(fixed if fixed != t else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["text", "repaired"])

    suspect = df.select(F.col(column).cast("string").alias("text")).where(F.col("text").rlike(r"[ÂÃÅâ][\x80-™]")).distinct()
    return suspect.mapInArrow(repair, "text string, repaired string").where("repaired IS NOT NULL")


def first_match(df: DataFrame, key: str, candidates: DataFrame, candidate_key: str, order: Sequence[str], row: Sequence[str], inside: Column | None = None) -> DataFrame:
    """Each row with one candidate: the only one ``inside`` holds for, else the first in order; ``matches`` counts the candidates."""
    both = df.join(candidates, F.col(key) == F.col(candidate_key), "left")
    ok = F.coalesce(inside, F.lit(False)) if inside is not None else F.lit(False)
    by = Window.partitionBy(*row)
    out = both.withColumn("_in", ok.cast("int")).withColumn("_ins", F.sum("_in").over(by)).withColumn("matches", F.count(candidate_key).over(by))
    out = out.withColumn("_r", F.row_number().over(by.orderBy(F.when(F.col("_ins") == 1, -F.col("_in")).otherwise(0), *order)))
    return out.where("_r = 1").drop("_in", "_ins", "_r")
