"""Benchmark decontamination by winnowing.

Of the hashes of k words in each window of w neighbouring ones the least is
kept, on both sides. Equal runs of w + k - 1 words have equal windows, so they
share a kept hash: no shared run of that length is missed. Here k = 5 and
w = 6, for runs of 10 words. Kept hashes of the benchmark set a bitmap of
fixed size; those of the corpus that pass it are joined with the benchmark's,
and each match is extended word by word on both sides.

Items of fewer words than a run are matched whole, by the hash of all their
words at each place of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, drop_rows, grams, hash_strings, long_array, mix, named_rows, partition_uid, scratch, slices, starts, string_buffers, texts

RUN, K = 10, 5
W = RUN - K + 1

_BYTES = np.full(256, 32, np.uint8)
_BYTES[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_BYTES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTES[128:] = np.arange(128, 256)


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case A-Z; words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""
    import pyarrow.compute as pc

    raw, offsets = string_buffers(text)
    clean = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_BYTES[raw].tobytes()))
    parts = pc.ascii_split_whitespace(clean)
    found = parts.flatten()
    edges = starts(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)
    return found.filter(pa.array(full)), np.diff(starts(full.astype(np.int64))[edges])


def winnow(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the kept runs of K words; h: all word hashes, counts: words of each text."""
    g = grams(h, K)
    n = len(h) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, W):
        x = g[j : j + n]
        lower = x < least
        least[lower] = x[lower]
        at[lower] = j
    ends = starts(counts)
    inside = np.arange(n) + RUN <= np.repeat(ends[1:], counts)[:n]
    places = np.unique((np.arange(n) + at)[inside])
    return g[places], places


def whole_runs(h: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each run of ``length`` words, for items shorter than a run."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(np.arange(n) + length <= np.repeat(starts(counts)[1:], counts)[:n])
    return mix(grams(h, length)[inside] ^ np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), inside


def _around(h: np.ndarray, ends: np.ndarray, owner: np.ndarray, places: np.ndarray, length: int, pad: int) -> list[bytes]:
    """Word hashes from RUN - length places before each place to as many after its ``length`` words; ``pad`` outside the text."""
    reach = RUN - length
    at = places[:, None] + np.arange(-reach, length + reach)[None, :]
    out = np.where((at >= ends[owner][:, None]) & (at < ends[owner + 1][:, None]), h[np.clip(at, 0, len(h) - 1)], np.uint64(pad))
    raw, width = np.ascontiguousarray(out).tobytes(), 8 * out.shape[1]
    return [raw[i * width : (i + 1) * width] for i in range(len(places))]


def _marks(text: pa.Array, lengths: list[int], keep, pad: int) -> tuple[np.ndarray, list[tuple]]:
    """Words of each text, and of each kind of mark (owner, fp, place in the text, span, surroundings)."""
    found, counts = words(text)
    h = hash_strings(found)
    ends = starts(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    kinds = []
    for length in [K, *lengths]:
        fp, at = winnow(h, counts) if length == K and not kinds else whole_runs(h, counts, length)
        if keep is not None and len(fp):
            m = keep(fp)
            fp, at = fp[m], at[m]
        elif kinds and len(at):  # an item is one window: only its own length counts
            m = counts[owner[at]] == length
            fp, at = fp[m], at[m]
        if len(fp):
            own = owner[at]
            # a whole item needs no surroundings: its own words are compared
            around = _around(h, ends, own, at, K, pad) if not kinds else _exact(h, at, length)
            kinds.append((own, fp, at - ends[own], length if kinds else 0, around))
        else:
            kinds.append(())
    return counts, [k for k in kinds if k]


def _exact(h: np.ndarray, at: np.ndarray, length: int) -> list[bytes]:
    raw, width = h[at[:, None] + np.arange(length)[None, :]].tobytes(), 8 * length
    return [raw[i * width : (i + 1) * width] for i in range(len(at))]


def _extend(batches):
    """(uid, item, first, last): the words that a match extends to, where that makes a window."""
    for batch in batches:
        uid, item, at, span, a, b = (batch.column(c).to_pylist() for c in ("uid", "item", "at", "span", "doc", "own"))
        rows = []
        for i in range(batch.num_rows):
            same = np.frombuffer(a[i], np.uint64) == np.frombuffer(b[i], np.uint64)
            if span[i]:
                if same.all():
                    rows.append((i, at[i], at[i] + span[i] - 1))
                continue
            left = right = RUN - K  # the run's K words begin here
            if not same[left : left + K].all():
                continue
            right += K - 1
            while left > 0 and same[left - 1]:
                left -= 1
            while right + 1 < len(same) and same[right + 1]:
                right += 1
            if right - left + 1 >= RUN:
                rows.append((i, at[i] + left - (RUN - K), at[i] + right - (RUN - K)))
        yield pa.RecordBatch.from_arrays([pa.array([uid[i] for i, _, _ in rows], pa.int64()), pa.array([item[i] for i, _, _ in rows], pa.string()), pa.array([x for _, x, _ in rows], pa.int64()), pa.array([x for _, _, x in rows], pa.int64())], names=["uid", "item", "first", "last"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, raw (64 bits of the text), n_words, n_hit, n_items, items (sorted ids as strings), contaminated: one row for each row of ``docs``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored. A null text has no words, and an item without words has no
    window. Items that share an id count once. Rows that repeat a doc_id are
    judged by their own texts. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession

    def count_words(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(words(texts(batch))[1])], names=["n"])

    short = sorted(r.n for r in benchmark.select("text").mapInArrow(count_words, "n long").where(f"n BETWEEN 1 AND {RUN - 1}").distinct().collect())  # 9 values at most

    def items_of(batches):
        for batch in slices(batches, "text"):
            _, kinds = _marks(texts(batch), short, None, 1)
            ids = batch.column("item").to_pylist()
            for own, fp, _, span, around in kinds:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own], pa.string()), long_array(fp), pa.array([span] * len(fp), pa.int32()), pa.array(around, pa.binary())], names=["item", "fp", "span", "own"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = scratch(named.mapInArrow(items_of, "item string, fp long, span int, own binary").distinct(), "items")
    held = spark.sparkContext.broadcast(Bitmap.collect(items, "fp"))

    def marks_of(batches):
        take = partition_uid()
        kind = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("span", pa.int32()), ("doc", pa.binary())]))
        for batch in slices(batches, "text"):
            counts, kinds = _marks(texts(batch), short, held.value.has, 0)
            marks: list[list] = [[] for _ in range(batch.num_rows)]
            for own, fp, at, span, around in kinds:
                for i, f, p, x in zip(own.tolist(), fp.view(np.int64).tolist(), at.tolist(), around, strict=True):
                    marks[i].append({"fp": f, "at": p, "span": span, "doc": x})
            yield pa.RecordBatch.from_arrays([pa.array(take(len(counts))), batch.column("doc_id"), batch.column("raw"), pa.array(counts), pa.array(marks, kind)], names=["uid", "doc_id", "raw", "n_words", "marks"])

    base = scratch(named_rows(docs).mapInArrow(marks_of, "uid long, doc_id long, raw long, n_words long, marks array<struct<fp:long,at:long,span:int,doc:binary>>"), "marks")
    marks = base.where(F.size("marks") > 0).select("uid", F.explode("marks").alias("m")).select("uid", "m.*")
    hits = scratch(marks.join(items, ["fp", "span"]).select("uid", "item", "at", "span", "doc", "own").mapInArrow(_extend, "uid long, item string, first long, last long").distinct(), "hits")

    before = Window.partitionBy("uid").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("uid", "first", "last").distinct().withColumn("done", F.coalesce(F.max("last").over(before), F.lit(-1)))
    n_hit = spans.groupBy("uid").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.col("done") + 1) + 1)).alias("n_hit"))
    ids = hits.select("uid", "item").distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = base.drop("marks").join(n_hit.join(ids, "uid"), "uid", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "raw", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that have a hit.

    Rows are told apart by doc_id (null too) and text, so a clean row stays
    whatever id it shares. Null and blank texts stay. All columns come back,
    whatever their names.
    """
    return drop_rows(docs, contamination(docs, benchmark).where("contaminated").select("doc_id", "raw"))
