"""Near-duplicate documents: tensored banding over MinHash, links confirmed on full sets.

Plain banding with T tables of r rows needs T * r MinHash values. Here two
small collections of M bands are formed, and each of the M * M tables is
keyed by one band of either: 2 * M * R values serve M * M tables of 2 * R
rows. A pair of similarity s meets in some table with probability
(1 - (1 - s ** R) ** M) ** 2; with the values below that is 0.99998 at 0.85 and
0.9998 at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, grams, hash_strings, keep_first, long_array, mix, named_rows, scratch, slices, split_words, spread_join, starts, texts
from .neardup import bands, distinct_sets, minhashes, near_duplicate_classes, set_hashes, set_rows

WORDS = 5
PERCENT = 85
#: Similarity from which the pipeline's stage takes documents for near copies.
STAGE_PERCENT = 80
#: Bands of a collection, and MinHash values of a band.
M, R = 9, 2


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and how many: 5 words each; of fewer words, one of all; of none, none."""
    words, counts = split_words(text)
    h = hash_strings(words)
    at = starts(counts)
    n = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(np.int64))
    g = grams(h, WORDS)
    long_rows = np.flatnonzero(counts >= WORDS)
    out = np.zeros(int(n.sum()), np.uint64)
    to = starts(n)
    if len(long_rows):
        own = np.repeat(np.arange(len(long_rows)), n[long_rows])
        step = np.arange(len(own)) - np.repeat(starts(n[long_rows])[:-1], n[long_rows])
        out[to[long_rows][own] + step] = g[at[long_rows][own] + step]
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        out[to[i]] = mix(grams(h[at[i] : at[i + 1]], int(counts[i])) + np.uint64(counts[i]))[0]
    return distinct_sets(out, n)


def row_keys(doc_id: pa.Array, text: pa.Array) -> np.ndarray:
    """64 bits that name a row by its doc_id and text, without splitting words; the sets are checked when joined."""
    import xxhash

    ids = pc.fill_null(doc_id.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).astype(np.uint64)
    return mix(mix(ids) ^ np.array([xxhash.xxh3_64_intdigest(x) for x in text.cast(pa.large_binary()).to_pylist()], np.uint64))


def _units(batches):
    for batch in slices(batches, "text", 4 << 20):
        text = texts(batch)
        s, n = shingle_sets(text)
        h1, h2 = set_hashes(s, n)
        rows, at = np.flatnonzero(n), starts(n[n > 0])
        sig = np.zeros((len(n), 2 * M), np.uint64)
        if len(rows):
            values = minhashes(s, at, 2 * M * R, 9)
            sig[rows] = np.concatenate([bands(values[:, : M * R], R, 1), bands(values[:, M * R :], R, 2)], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * M)), long_array(sig.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(n), long_array(h1), long_array(h2), long_array(row_keys(batch.column("doc_id"), text)), lists], names=["doc_id", "raw", "n", "h1", "h2", "rk", "sig"])


def _keys(reps: DataFrame) -> DataFrame:
    a = reps.select("uid", F.explode(F.slice("sig", 1, M)).alias("a"), "sig")
    return a.select("uid", "a", F.explode(F.slice("sig", M + 1, M)).alias("b")).select(F.xxhash64("a", "b").alias("key"), "uid")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, raw, group: one row for each row of ``docs`` (doc_id long, text; others are ignored).

    Links join documents whose sets of 5-word shingles have 100 * common >=
    percent * union; component_id is the least doc_id that links reach, kept is
    doc_id = component_id. A null or blank text has no shingles and is linked
    with nothing. Rows that repeat a doc_id are linked by their own texts; a
    null doc_id ranks last and is kept only if its whole component has none.
    raw is 64 bits of the text, group a name of the component (null without
    words): rows with one component_id may be of several groups where a doc_id
    repeats. An empty table gives an empty result.
    """
    rows = named_rows(docs)
    base = scratch(rows.mapInArrow(_units, "doc_id long, raw long, n long, h1 long, h2 long, rk long, sig array<long>"), "units")

    def sets_of(bitmap: Bitmap) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(bitmap)

        def fetch(batches):
            for batch in slices(batches, "text", 4 << 20):
                rk = row_keys(batch.column("doc_id"), texts(batch))
                at = np.flatnonzero(held.value.has(rk))
                if len(at):
                    part = batch.take(pa.array(at))
                    s, n = shingle_sets(texts(part))
                    h1, h2 = set_hashes(s, n)
                    yield set_rows({"rk": rk[at], "h1": h1, "h2": h2}, s, n)

        return rows.select("doc_id", "text").mapInArrow(fetch, "rk long, h1 long, h2 long, body binary")

    units = base.where("n > 0").withColumn("label", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    linked = near_duplicate_classes(units, _keys, sets_of, percent, 2 * M)
    # Equal sets are linked without any candidate.
    equal = units.groupBy("h1", "h2").agg(F.min("label").alias("own"), F.count("*").alias("size")).where("size > 1").drop("size")
    named = equal.join(linked, ["h1", "h2"], "full").select("h1", "h2", "group", F.least("comp", "own").alias("comp"))
    comp = F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    comp = F.when(comp == (1 << 63) - 1, F.lit(None)).otherwise(comp)
    group = F.when(F.col("n") > 0, F.coalesce("group", F.xxhash64("h1", "h2")))
    out = spread_join(base.drop("sig"), named, ["h1", "h2"], "rk", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"), "raw", group.alias("group"))


def drop_near_duplicates(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id, null last, then by its text.

    Rows are told apart by doc_id and text, so rows that share a doc_id are
    judged one by one. Rows without words (null, empty, blank) stay, and so do
    all rows outside a component. All columns come back, whatever their names.
    """
    return keep_first(docs, near_duplicates(docs, percent).select("doc_id", "raw", "group"), [])
