"""Exact deduplication with counting quotient filters.

1. One pass hashes every normalised text: a 64-bit fingerprint, its SHA-256
   and its length go to a narrow scratch table.
2. Each partition builds counting quotient filters over its fingerprints, one
   for each range of quotients. A filter holds its fingerprints losslessly as
   (quotient, sorted remainders, counts), so filters of different partitions
   merge by merging sorted runs and adding counts.
3. Fingerprints counted more than once go to byte verification: the texts that
   have them are grouped by their own bytes, map-side first, so a group of
   copies that holds a third of all rows leaves one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, keep_first, long_array, named_rows, scratch, slices, spread_join

#: What normalising deletes: blank, tab, line feed, vertical tab, form feed, carriage return.
DELETED = b" \t\n\x0b\x0c\r"
#: Fingerprints a range of quotients should hold when merged.
RANGE_ROWS = 200_000


class CountingQuotientFilter:
    """A lossless multiset of 64-bit fingerprints.

    The top ``q`` bits of a fingerprint are its quotient, the rest its
    remainder. ``occupieds`` has a bit for each quotient in use (of the
    ``1 << q`` from ``base`` on), ``runends`` a bit for each slot that ends a
    quotient's run; remainders are sorted within a run, and ``counts`` are kept
    beside them.
    """

    def __init__(self, q: int, base: int, occupieds: np.ndarray, runends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.base = q, base
        self.occupieds, self.runends, self.remainders, self.counts = occupieds, runends, remainders, counts

    @staticmethod
    def build(fingerprints: np.ndarray, counts: np.ndarray, q: int, base: int, span: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints whose quotients lie in [base, base + span)."""
        r = np.uint64(64 - q)
        quotients = (fingerprints >> r).astype(np.int64) - base if q else np.zeros(len(fingerprints), np.int64)
        occupieds = np.zeros(span, bool)
        occupieds[quotients] = True
        runends = np.append(quotients[1:] != quotients[:-1], True) if len(quotients) else np.zeros(0, bool)
        remainders = fingerprints & ((np.uint64(1) << r) - np.uint64(1)) if q else fingerprints
        return CountingQuotientFilter(q, base, np.packbits(occupieds), np.packbits(runends), remainders, counts)

    def fingerprints(self) -> np.ndarray:
        """All of them, sorted."""
        n = len(self.remainders)
        ends = np.flatnonzero(np.unpackbits(self.runends, count=n))
        used = np.flatnonzero(np.unpackbits(self.occupieds))[: len(ends)]
        quotients = np.repeat(used, np.diff(np.concatenate([[-1], ends]))).astype(np.uint64) + np.uint64(self.base)
        return (quotients << np.uint64(64 - self.q)) | self.remainders if self.q else self.remainders

    @staticmethod
    def merge(filters: list[CountingQuotientFilter], span: int) -> CountingQuotientFilter:
        """Sorted runs are merged and the counts of equal fingerprints added: nothing is lost."""
        keys = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, first) if len(keys) else counts
        return CountingQuotientFilter.build(keys[first], counts, filters[0].q, filters[0].base, span)

    def count(self, fingerprint: int) -> int:
        keys = self.fingerprints()
        at = int(np.searchsorted(keys, np.uint64(fingerprint)))
        return int(self.counts[at]) if at < len(keys) and keys[at] == np.uint64(fingerprint) else 0

    def to_row(self) -> tuple:
        return self.occupieds.tobytes(), self.runends.tobytes(), self.remainders.tobytes(), self.counts.astype(np.int64).tobytes()

    @staticmethod
    def from_row(q: int, base: int, occupieds: bytes, runends: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        return CountingQuotientFilter(q, base, *(np.frombuffer(x, t) for x, t in ((occupieds, np.uint8), (runends, np.uint8), (remainders, np.uint64), (counts, np.int64))))


def _fingerprint(data: bytes) -> tuple[bytes, bytes]:
    text = data.translate(None, DELETED)
    return text, hashlib.sha256(text).digest()


def _hashed(batches):
    for batch in slices(batches, "text"):
        data = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
        digests = [_fingerprint(x)[1] for x in data]
        chars = pc.utf8_length(pc.fill_null(batch.column("text").cast(pa.large_string()), "")).cast(pa.int64())
        fp = np.frombuffer(b"".join(digests), np.uint64)[::4]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("raw"), long_array(fp), pa.array(digests, pa.binary()), chars], names=["doc_id", "raw", "fp", "sha", "chars"])


def fingerprint_counts(hashed: DataFrame, n_rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(fp, n): every distinct fingerprint and how many rows have it, from the merged filters."""
    ranges = max(1, n_rows // range_rows)
    top = max(0, int(np.ceil(np.log2(ranges))))  # a range is a prefix of ``top`` bits
    q = min(60, top + max(1, int(np.ceil(np.log2(max(2, n_rows / (1 << top)))))))
    span = 1 << (q - top)

    def filters(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            held[:] = [(keys[first], np.add.reduceat(counts, first))]

        for batch in batches:
            if batch.num_rows:
                held.append(np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True))
                if len(held) > 16:
                    fold()
        if not held:
            return
        fold()
        keys, counts = held[0]
        ids = (keys >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(keys), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            f = CountingQuotientFilter.build(keys[a:b], counts[a:b], q, int(ids[a]) * span, span)
            yield pa.RecordBatch.from_arrays([pa.array([ids[a]], pa.int64()), *(pa.array([x], pa.binary()) for x in f.to_row())], names=["part", "occupieds", "runends", "remainders", "counts"])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, whole = key[0].as_py() * span, None
        for batch in batches:
            rows = [CountingQuotientFilter.from_row(q, base, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("occupieds", "runends", "remainders", "counts")), strict=True)]
            whole = CountingQuotientFilter.merge([*([whole] if whole else []), *rows], span)
        yield pa.RecordBatch.from_arrays([long_array(whole.fingerprints()), pa.array(whole.counts.astype(np.int64))], names=["fp", "n"])

    rows = hashed.select("fp").mapInArrow(filters, "part long, occupieds binary, runends binary, remainders binary, counts binary")
    return rows.groupBy("part").applyInArrow(merged, "fp long, n long")


def _routed(bitmap):
    def route(batches):
        has = bitmap.value.has
        for batch in slices(batches, "text"):
            pairs = [_fingerprint(x) for x in pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()]
            at = np.flatnonzero(has(np.frombuffer(b"".join(d for _, d in pairs), np.uint64)[::4]))
            if not len(at):
                continue
            chars = pc.utf8_length(pc.fill_null(batch.column("text").cast(pa.large_string()), "")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(at)), pa.array([pairs[i][1] for i in at], pa.binary()), pa.array([pairs[i][0] for i in at], pa.binary()), chars.take(pa.array(at))],
                names=["doc_id", "sha", "body", "chars"],
            )

    return route


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hashed rows, groups of two or more with their keeper), after byte verification."""
    spark = docs.sparkSession
    rows = named_rows(docs)
    hashed = scratch(rows.mapInArrow(_hashed, "doc_id long, raw long, fp long, sha binary, chars long"), "hashed")
    repeated = fingerprint_counts(hashed, hashed.count()).where("n > 1")
    bitmap = spark.sparkContext.broadcast(Bitmap.collect(repeated, "fp"))
    routed = rows.mapInArrow(_routed(bitmap), "doc_id long, sha binary, body binary, chars long")
    # The body is a grouping key: equality is that of bytes, not of a hash.
    verified = routed.groupBy("sha", "body").agg(F.count("*").alias("n"), F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "chars", (-F.col("doc_id")).alias("minus"))).alias("top"))
    groups = verified.groupBy("sha").agg(F.sum("n").alias("group_size"), F.max("top").alias("top"), F.count("*").alias("bodies"))
    groups = groups.where("group_size > 1").select(
        "sha",
        F.when(F.col("bodies") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("group_size"),
        (-F.col("top.minus")).alias("keep_id"),
    )
    return hashed, groups


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal normalised texts: doc_id, raw (64 bits of the text as it is), keep_id, group_size, kept, text_sha256.

    One row for each row of ``docs``, which needs doc_id (long) and text; other
    columns are ignored. Null
    counts as the empty text, and all empty texts are copies of each other. Of
    equal texts the row with the most code points stays, then the smallest
    doc_id; rows that repeat both text and doc_id are all marked kept. A null
    doc_id is ranked last, however long its text, and never equals a keep_id. An empty table gives an
    empty result.
    """
    hashed, groups = _groups(docs)
    out = spread_join(hashed, groups, ["sha"], ["doc_id", "raw"], "left")
    return out.select(
        "doc_id",
        "raw",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("keep_id", "doc_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: one that has a doc_id, then the longest, then the least doc_id.

    Rows are told apart by doc_id and text, so rows that share a doc_id are
    judged one by one, and of rows equal in both one stays. Null and blank texts
    are copies of each other. Copies none of which has a doc_id leave one row
    too. All columns come back, whatever their names.
    """
    hashed, groups = _groups(docs)
    judged = spread_join(hashed, groups.select("sha"), ["sha"], ["doc_id", "raw"])
    judged = judged.select("doc_id", "raw", F.col("sha").alias("group"), "chars")
    return keep_first(docs, judged, [F.col("doc_id").isNull(), -F.col("chars")])
