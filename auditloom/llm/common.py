"""Helpers shared by the training-data operators.

* ``scratch``: materialises an intermediate table in the folder that the
  cluster shares (``spark.checkpoint.dir``), which cuts lineage: a lost
  executor costs a re-read, not a recomputation.
* word splitting and hashing over whole Arrow columns (no Python object per
  word).
* ``Bitmap``: a hash filter of fixed size.  It is the only thing built from
  the corpus that is ever broadcast, and its size doesn't depend on the data;
  what passes it is joined exactly afterwards, so a full bitmap costs time,
  never rows.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BITMAP_BITS = 1 << 26


# --- scratch tables ---------------------------------------------------------


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it isn't set, a temporary folder, but only if driver and executors are one process.

    On a cluster a folder of one machine would lose rows, so its absence is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        folder = tempfile.mkdtemp(prefix="auditloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_ROOTS[context.applicationId] = "file://" + folder
    return _LOCAL_ROOTS[context.applicationId]


def _hadoop(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; the table goes with the session, or by ``discard``."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/auditloom-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    files, hpath = _hadoop(spark, path)
    files.deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing still to be computed reads."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            files, hpath = _hadoop(df.sparkSession, path)
            files.delete(hpath, True)


# --- Arrow ------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes at most (one row may exceed it)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a == n:
                yield batch
            elif b > a:  # a copy: not every kernel minds the offset of a slice
                yield batch.take(pa.array(np.arange(a, b)))


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as strings with null replaced by the empty string, in one chunk starting at offset 0."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def string_buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large_string array."""
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case A-Z and split on [\\x20\\x09-\\x0D]+: all words in order, and each row's number of words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(a))
    words = parts.flatten()
    offsets = starts(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return words, np.diff(offsets)
    total = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    return words.filter(pa.array(full)), np.diff(total[offsets])


# Tabulation hashing: a random 64-bit word for each (place in the word, byte).
_PLACES = 32
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, size=(_PLACES, 256), dtype=np.uint64)
_FLAT = _TABLE.reshape(-1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_strings(a: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings of an array without nulls."""
    n = len(a)
    raw, offsets = string_buffers(a.cast(pa.large_string()))
    lengths = np.diff(offsets)
    out = np.zeros(n, np.uint64)
    if len(raw):
        place = np.arange(len(raw), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
        values = _FLAT[((place & (_PLACES - 1)) << 8) | raw]
        if lengths.max(initial=0) > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            values[far] *= mix((place[far] >> 5).astype(np.uint64)) | U64(1)
        full = np.flatnonzero(lengths)
        out[full] = np.add.reduceat(values, offsets[full])
    return mix(out + lengths.astype(np.uint64) * U64(0x9E3779B97F4A7C15))


_POWERS = [U64(pow(0x9E3779B97F4A7C15 | 1, k, 1 << 64)) for k in range(1, 65)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (at its first place); len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _POWERS[0]
    for j in range(1, k):
        out += h[j : j + m] * _POWERS[j]
    return mix(out)


def starts(counts: np.ndarray) -> np.ndarray:
    """Offsets from counts, with the total last."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


# --- filters of fixed size --------------------------------------------------


class Bitmap:
    """Two bits out of 2**26 for each 64-bit key."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64, copy=False) + U64(0x632BE59BD9B4E019))
        mask = U64(_BITMAP_BITS - 1)
        return h & mask, (h >> U64(32)) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        one = U64(1)
        a, b = self._bits(keys)
        w = self.words
        return ((w[(a >> U64(6)).astype(np.int64)] >> (a & U64(63))) & (w[(b >> U64(6)).astype(np.int64)] >> (b & U64(63))) & one).astype(bool)

    @staticmethod
    def collect(df: DataFrame, key: str) -> Bitmap:
        """OR together the bits of all keys; at most 2**20 words of 64 bits reach the driver, however many keys there are."""

        def bits(batches):
            seen = np.zeros(_BITMAP_BITS >> 6, np.uint64)
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for b in Bitmap._bits(keys):
                    np.bitwise_or.at(seen, (b >> U64(6)).astype(np.int64), U64(1) << (b & U64(63)))
            at = np.flatnonzero(seen)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), long_array(seen[part])], names=["at", "word"])

        rows = df.select(F.col(key).alias("k")).mapInArrow(bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(_BITMAP_BITS >> 6, np.uint64)
        words[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
        return Bitmap(words)


def partition_uid() -> Callable[[int], np.ndarray]:
    """Row ids unique in one pass: the partition's number and a counter. Only to be used in what is written at once."""
    from pyspark import TaskContext

    base, at = TaskContext.get().partitionId() << 33, 0

    def take(n: int) -> np.ndarray:
        nonlocal at
        out = np.arange(base + at, base + at + n, dtype=np.int64)
        at += n
        return out

    return take


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], by: str | list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``many`` joined with ``few``, which has one row for each key: a key's rows of ``many`` are dealt by ``by`` to ``salts`` tasks."""
    salt = F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), F.lit(salts)).cast("int")
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("__salt", salt).join(copies, [*keys, "__salt"], how).drop("__salt")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: others, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def blank_text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


# --- rows -------------------------------------------------------------------


def named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, raw (64 bits of the text as it is) and text: what names a row where ids repeat or are null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(blank_text()).alias("raw"), F.col("text").cast("string").alias("text"))


def _whole(docs: DataFrame) -> DataFrame:
    """row (all columns as one, so that no helper's name can clash with theirs), doc_id, raw."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(blank_text()).alias("raw"))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text are in ``gone`` (doc_id, raw); a null doc_id equals itself.

    ``gone`` is written first: by its true size Spark knows whether ``docs`` needs to be shuffled at all.
    """
    rows = _whole(docs)
    out = scratch(gone.select(F.col("doc_id").alias("gone_id"), F.col("raw").alias("gone_raw")).distinct(), "gone")
    return rows.join(out, (rows["raw"] == out["gone_raw"]) & rows["doc_id"].eqNullSafe(out["gone_id"]), "left_anti").select("row.*")


def keep_first(docs: DataFrame, judged: DataFrame, order: list[Column]) -> DataFrame:
    """``docs`` with one row of each group: the least by ``order``, then by doc_id (null last) and text.

    ``judged`` has doc_id, raw and group for every row of ``docs``; a null group
    is no group. Rows equal in doc_id and text are one decision, and one of them
    stays. No group is gathered: its first row is found map-side, and rows are
    dealt out over salts when they are held against it.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("doc_id").isNull().alias("unnamed"), "doc_id", "raw")
    rows = scratch(judged.where("group IS NOT NULL").select("group", "doc_id", "raw", rank.alias("rank")), "judged")
    firsts = rows.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("size")).where("size > 1")
    both = spread_join(rows, firsts.drop("size"), ["group"], ["doc_id", "raw"])
    held = scratch(both.groupBy("doc_id", "raw").agg(F.max(F.col("rank") == F.col("first")).alias("stays"), F.count("*").alias("times")).where("NOT stays OR times > 1"), "held")
    discard(rows)
    left = drop_rows(docs, held.where("NOT stays"))
    again = held.where("stays").select(F.col("doc_id").alias("again_id"), F.col("raw").alias("again_raw"))
    if again.isEmpty():
        return left
    rows = _whole(left)
    same = (rows["raw"] == again["again_raw"]) & rows["doc_id"].eqNullSafe(again["again_id"])
    once = rows.join(again, same, "left_semi").groupBy("doc_id", "raw").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.join(again, same, "left_anti").select("row.*").unionByName(once.select("row.*"))
