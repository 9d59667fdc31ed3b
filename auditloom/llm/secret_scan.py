"""Secret scans over a ledger of blobs, with DataFrame and SQL functions only.

Every version of a text is a blob, named by the SHA-256 of its bytes. The
ledger holds the (blob, rule, version) triples scanned before; only those that
it lacks are scanned, each distinct blob once, and the findings are joined back
to all rows (paths) that hold the blob.

SQL's regular expressions don't give places, so they come from lengths: the
text splits into what lies between the matches, and a match begins after all
pieces and matches before it. The lengths of a text are rows, summed by a
window, so a text with very many matches takes no more than linear time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, spread_join


@dataclass(frozen=True)
class Rule:
    """``least`` is the length that ``group`` of a match must have; ``rule``'s rank orders spans that begin together."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: Hex runs and access keys are looked for at their full length at once: a run begins at its first character either way.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)


def unseen(blobs: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None) -> DataFrame:
    """``blobs`` with ``todo``: the names of the rules whose present version the ledger lacks for the blob; none: no row."""
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", names)
    known = ledger.where(" OR ".join(f"(rule = '{r.name}' AND version = {r.version})" for r in rules))
    done = known.groupBy("blob").agg(F.collect_set("rule").alias("done"))
    left = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
    return left.where(F.size("todo") > 0).drop("done")


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and blob, the SHA-256 of the text: one row for each version of each path."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, rule, rank, start, end): places in code points, end exclusive, of what each rule in ``todo`` finds in ``text``."""
    text = F.col("text")

    def lengths(r: Rule):
        pattern, lit = F.lit(r.pattern), F.lit
        return F.when(
            F.array_contains("todo", r.name) & text.rlike(r.pattern),
            F.arrays_zip(
                F.transform(F.split(text, r.pattern, -1), F.length).alias("gap"),
                F.transform(F.regexp_extract_all(text, pattern, lit(0)), F.length).alias("match"),
                F.transform(F.regexp_extract_all(text, pattern, lit(r.group)), F.length).alias("held"),
            ),
        )

    found = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("rank"), F.lit(r.least).alias("least"), lengths(r).alias("hits")) for i, r in enumerate(rules)])
    rows = blobs.select("blob", F.explode(found).alias("f")).where("f.hits IS NOT NULL").select("blob", "f.rule", "f.rank", "f.least", F.posexplode("f.hits").alias("i", "h"))
    before = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("h.gap") + F.coalesce("h.match", F.lit(0))).over(before))
    return placed.where("h.held >= least").select("blob", "rule", "rank", (F.col("end") - F.col("h.match")).alias("start"), "end")


def increment(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) after scanning the blobs of ``docs`` for what ``ledger`` lacks, both written to the shared folder.

    What is unseen is decided on hashes, so a blob that the ledger knows is not
    scanned again, and equal texts are scanned once. findings: (blob, rule,
    version, rank, start, end) with the earlier ``findings``; ledger: all (blob,
    rule, version) scanned so far. Give both to the next increment. The ledger
    is written last: what fails in between is scanned again, never missed.
    """
    rows = versions(docs)
    if ledger is None:
        todo = unseen(rows.groupBy("blob", "text").count().drop("count"), rules, None)
        left = unseen(rows.select("blob").distinct(), rules, None)
    else:
        left = scratch(unseen(rows.select("blob").distinct(), rules, ledger), "unseen")
        todo = spread_join(rows, left, ["blob"], "doc_id").groupBy("blob", "text", "todo").count().drop("count")
    number = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    found = scratch(scan(todo, rules).select("blob", "rule", number[F.col("rule")].alias("version"), "rank", "start", "end"), "findings")
    done = scratch(left.select("blob", F.explode("todo").alias("rule")).select("blob", "rule", number[F.col("rule")].alias("version")), "ledger")
    if findings is not None:
        found = findings.select(*found.columns).unionByName(found)
    if ledger is not None:
        done = ledger.select(*done.columns).unionByName(done)
    return found, done


def secret_scan(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, ledger) after scanning what the ledger lacks.

    ``docs``: doc_id and text, one row for each version of each path; other
    columns are ignored, a null text is empty, a null doc_id is passed on, and
    repeated rows are each reported. paths: doc_id, blob and its spans by the
    present versions of ``rules``, an array of (start, rank, rule, end), empty if
    there are none; findings and ledger as ``increment`` gives them. Empty tables
    give empty results.
    """
    found, done = increment(docs, rules, ledger, findings)
    present = found.where(" OR ".join(f"(rule = '{r.name}' AND version = {r.version})" for r in rules))
    by_blob = present.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "rule", "end"))).alias("spans"))
    paths = spread_join(versions(docs).select("doc_id", "blob"), by_blob, ["blob"], "doc_id", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,rule:string,end:bigint>>")
    return paths.select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), found, done
