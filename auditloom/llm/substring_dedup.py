"""Repeated passages across documents: units compared by similarity, and every shared run of RUN words.

A paragraph is a line, or neighbouring lines that are hard-wrapped; the
sentences of a line, where it has several, are units too. A unit's set holds its
5-word shingles (of words [^\\x20\\x09-\\x0D]+, with A-Z in lower case). Eight
bands of two MinHash values let a pair of similarity 0.8 meet with probability
1 - (1 - 0.8 ** 2) ** 8 = 0.9997. Sentences of under NEAR words are compared by
equal sets alone, as one changed word in the midst of them leaves less than 0.8.
Colliding units are joined, their sets compared exactly, and removals follow the components of the confirmed links: of
each, the first passage (by document, then place) stays.

Passages lie within others, so the first one may go with what holds it. Where a
line goes for a *near* copy, what it holds has no equal in the line that stays;
such passages are ranked last. If all of a component are such, none of it is
removed for its own sake. So whatever has a copy outside the near copies that
go stays once (words of a longer passage may stay at different places).

A passage may begin anywhere, so each RUN words in a row are compared as well,
whatever the lines, wherever units that go leave a word of them. RUN words hold RUN - SEED + 1 runs of
SEED words; equal ones have the same least hash among these, so only windows
whose least hash occurs twice or more are written out and grouped by a 64-bit
hash. Windows that have a copy and lie on one diagonal make one run, which so
reaches as far as the words agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _POWERS, Bitmap, blank_text, discard, hash_strings, long_array, mix, named_rows, scratch, slices, split_words, starts, string_buffers, texts
from .minhash_dedup import shingle_sets
from .neardup import bands, minhashes, near_duplicate_classes, set_hashes, set_rows

PERCENT = 80
BANDS, ROWS = 8, 2
#: What parts the sentences of a line: a stop and one blank.
SENTENCE_END = r"[.!?]\s"
#: Default of ``min_words``. Shorter lines and sentences (headings, list items, signatures) repeat by nature and stay
#: unless they lie in a longer passage that repeats; with 1 every line and sentence is a unit.
MIN_WORDS = 10
_LAST = (1 << 63) - 1
#: Neighbouring lines of fewer words are a hard-wrapped paragraph, taken as one unit.
WRAPPED = 20
#: Sentences of so many words have bands, too: (NEAR - 4 - 5) / (NEAR - 4 + 5) = 0.8.
NEAR = 49
#: Any run of so many words that occurs twice is found; SEED words of it are looked up first.
RUN, SEED = 50, 26
#: Bytes of text that are taken at a time: a worker makes some sixty times as much of them.
SLICE = 1 << 20


def _slices(batches):
    """Slices of the batches; then a worker's free memory goes back, as it waits beside the stages that run."""
    yield from slices(batches, "text", SLICE)
    pa.default_memory_pool().release_unused()


def paragraphs(doc_id: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the line in its text, line) of every line."""
    lines = pc.split_pattern(text, "\n")
    n = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(starts(n)[:-1], n), lines.flatten()


def word_counts(a: pa.Array) -> np.ndarray:
    """Words of each text: places where a byte that isn't blank follows a blank or begins the text."""
    raw, offsets = string_buffers(a)
    if not len(raw):
        return np.zeros(len(a), np.int64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    begins = ~blank & (first[:-1] | np.append(True, blank[:-1]))
    before = starts(begins.astype(np.int64))
    return before[offsets[1:]] - before[offsets[:-1]]


def _within(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each item begins in its group, from the groups' numbers of items and the items' sizes."""
    edges = starts(counts)
    place = starts(sizes)
    return place[:-1] - np.repeat(place[edges[:-1]], counts)


def _units_of(batch: pa.RecordBatch, least: int) -> dict:
    """Lines of ``least`` words or more, hard-wrapped paragraphs, and sentences of lines that have several; places are code points."""
    row, number, line = paragraphs(batch.column("doc_id"), texts(batch))
    line = line.cast(pa.large_string())
    chars = pc.utf8_length(line).to_numpy(zero_copy_only=False).astype(np.int64)
    place = _within(np.bincount(row, minlength=batch.num_rows), chars + 1)
    n_words = word_counts(line)
    wrapped = _wrapped(row, number, line, chars, place, n_words, least)
    keep = np.flatnonzero(n_words >= least)
    row, number, chars, place, n_words, line = row[keep], number[keep], chars[keep], place[keep], n_words[keep], line.take(pa.array(keep))

    parts = pc.split_pattern_regex(line, SENTENCE_END)
    several = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    sentence = parts.flatten()
    size = pc.utf8_length(sentence).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(place, several) + _within(several, size + 2)
    sentence = pc.utf8_rtrim(sentence, ".!?").cast(pa.large_string())
    words = word_counts(sentence)
    own = np.repeat(np.arange(len(row)), several)
    # A sentence that is most of its line is linked with whatever it is linked with as the line.
    most = 100 * np.maximum(words - 4, 1) >= PERCENT * np.maximum(n_words[own] - 4, 1)
    some = np.flatnonzero((words >= least) & (several[own] > 1) & ~most)
    short = sentence.take(pa.array(some))
    return {
        "kind": ["line"] * len(row) + ["paragraph"] * len(wrapped["row"]) + ["sentence"] * len(some),
        "row": np.concatenate([row, wrapped["row"], row[own[some]]]),
        "line": np.concatenate([number, wrapped["line"], number[own[some]]]),
        "start": np.concatenate([place, wrapped["start"], at[some]]),
        "n_chars": np.concatenate([chars, wrapped["n_chars"], pc.utf8_length(short).to_numpy(zero_copy_only=False).astype(np.int64)]),
        "n_words": np.concatenate([n_words, wrapped["n_words"], words[some]]),
        "text": pa.concat_arrays([line, wrapped["text"], short]),
    }


def _wrapped(row: np.ndarray, number: np.ndarray, line: pa.Array, chars: np.ndarray, place: np.ndarray, n_words: np.ndarray, least: int) -> dict:
    """Neighbouring lines of 1 to WRAPPED - 1 words, two or more, that have ``least`` words together."""
    some = (n_words > 0) & (n_words < WRAPPED)
    goes_on = np.append(False, some[1:] & some[:-1] & (row[1:] == row[:-1])) if len(row) else some
    first = np.flatnonzero(some & ~goes_on)
    last = np.flatnonzero(some & ~np.append(goes_on[1:], False)) if len(row) else first
    words = starts(n_words)
    several = (last > first) & (words[last + 1] - words[first] >= least)
    first, last = first[several], last[several]
    n = last - first + 1
    edges = starts(n)
    lines = line.take(pa.array(np.repeat(first, n) + np.arange(edges[-1]) - np.repeat(edges[:-1], n)))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), lines), pa.scalar("\n", pa.large_string()))
    return {"row": row[first], "line": number[first], "start": place[first], "n_chars": place[last] + chars[last] - place[first], "n_words": words[last + 1] - words[first], "text": text.cast(pa.large_string())}


def _row_keys(batch: pa.RecordBatch, u: dict) -> np.ndarray:
    """64 bits for each unit: its text and its place there."""
    raw, ids = (pc.fill_null(batch.column(c).cast(pa.int64()), -1).to_numpy(zero_copy_only=False).astype(np.uint64) for c in ("raw", "doc_id"))
    return mix(mix(mix(ids ^ mix(raw))[u["row"]] ^ u["start"].astype(np.uint64)) ^ u["n_chars"].astype(np.uint64))


_UNITS = "doc_id long, raw long, kind string, line long, start long, n_chars long, n_words long, n long, h1 long, h2 long, rk long, sig array<long>"


def _units(least: int):
    def run(batches):
        for batch in _slices(batches):
            u = _units_of(batch, least)
            s, n = shingle_sets(u["text"])
            h1, h2 = set_hashes(s, n)
            kind, row = pa.array(u["kind"], pa.string()), pa.array(u["row"])
            banded = (n > 0) & (pc.not_equal(kind, "sentence").to_numpy(zero_copy_only=False) | (u["n_words"] >= NEAR))
            sig = np.zeros((0, BANDS), np.uint64)
            if banded.any():
                sig = bands(minhashes(s[np.repeat(banded, n)], starts(n[banded]), BANDS * ROWS, 2), ROWS, 3)
            lists = pa.ListArray.from_arrays(pa.array(starts(banded * BANDS).astype(np.int32)), long_array(sig.reshape(-1)), mask=pa.array(~banded))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("raw").take(row), kind, *(pa.array(u[c]) for c in ("line", "start", "n_chars", "n_words")), pa.array(n), long_array(h1), long_array(h2), long_array(_row_keys(batch, u)), lists],
                names=["doc_id", "raw", "kind", "line", "start", "n_chars", "n_words", "n", "h1", "h2", "rk", "sig"],
            )

    return run


def _sums(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes at its first place, by doubling; len(h) - k + 1 of them."""
    m = max(len(h) - k + 1, 0)
    out, power, size, at = np.zeros(m, np.uint64), h, 1, 0
    while at < k:
        if k & size:
            out += power[at : at + m] * (_POWERS[at - 1] if at else np.uint64(1))
            at += size
        power = power[:-size] + power[size:] * _POWERS[size - 1] if len(power) > size else power[:0]
        size *= 2
    return mix(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _windows(text: pa.Array, covered: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(word hashes of all texts, word where each window of RUN words begins, its text, the least hash of its runs of SEED words, places).

    Windows all of whose words lie in ``covered`` (code points, by text) are left out.
    """
    words, counts = split_words(text)
    h = hash_strings(words)
    places = _word_places(text)
    if len(h) < RUN:
        return h, *(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64)), places
    edges = starts(counts)
    room = np.arange(len(h)) + RUN <= np.repeat(edges[1:], counts)
    gone = np.zeros(len(h), np.int64)
    spans = covered.flatten()
    if len(spans):
        own = np.repeat(np.arange(len(counts)), pc.fill_null(pc.list_value_length(covered), 0).to_numpy(zero_copy_only=False))
        wide = int(places[1].max(initial=0)) + int(pc.max(spans.field("stop")).as_py()) + 2  # texts one after the other on one line
        at = np.repeat(np.arange(len(counts)), counts) * wide
        first, stop = (spans.field(c).to_numpy(zero_copy_only=False) + own * wide for c in ("start", "stop"))
        change = np.zeros(len(h) + 1, np.int64)
        low, high = np.searchsorted(at + places[0], first, "left"), np.searchsorted(at + places[1], stop, "right")
        np.add.at(change, low[high > low], 1)
        np.add.at(change, high[high > low], -1)
        gone = (np.cumsum(change[:-1]) > 0).astype(np.int64)
    left = starts(1 - gone)
    at = np.flatnonzero(room & (left[np.minimum(np.arange(len(h)) + RUN, len(h))] > left[:-1]))
    low = _least(_sums(h, SEED), RUN - SEED + 1)
    return h, at, np.repeat(np.arange(len(counts)), counts)[at], low[at], places


def _seeds(at: np.ndarray, row: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of some windows give their least hash, once for each place: one place is least in so many neighbouring windows at most."""
    new = np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | (np.diff(at) > 1))
    first = np.flatnonzero(new)
    step = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return np.flatnonzero(step % (RUN - SEED + 1) == 0)


def _word_places(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first code point of each word, the one after its last, number of the word in its text)."""
    raw, offsets = string_buffers(text)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(~blank & (edge[:-1] | np.append(True, blank[:-1])))
    last = np.flatnonzero(~blank & (edge[1:] | np.append(blank[1:], True))) + 1
    points = starts(((raw & 0xC0) != 0x80).astype(np.int64))
    row = np.searchsorted(offsets, first, "right") - 1
    counts = np.bincount(row, minlength=len(offsets) - 1)
    return points[first] - points[offsets[row]], points[last] - points[offsets[row]], np.arange(len(first)) - np.repeat(starts(counts)[:-1], counts)


def _candidates(held):
    """Windows whose least hash is in a bitmap; dead: they overlap a passage that goes for a near copy."""

    def run(batches):
        for batch in _slices(batches):
            h, at, row, low, (first, last, number) = _windows(texts(batch), batch.column("covered"))
            some = np.flatnonzero(held.value.has(low))
            if not len(some):
                continue
            at, row = at[some], row[some]
            start, stop = first[at], last[at + RUN - 1]
            dead = np.zeros(len(at), bool)
            for i, spans in enumerate(batch.column("lossy").to_pylist()):
                a, b = np.searchsorted(row, [i, i + 1])
                for x in spans:
                    dead[a:b] |= (start[a:b] < x["stop"]) & (stop[a:b] > x["start"])
            own = pa.array(row)
            ids = pc.fill_null(batch.column("doc_id"), _LAST)
            yield pa.RecordBatch.from_arrays(
                [long_array(_sums(h, RUN)[at]), pa.array(dead), ids.take(own), batch.column("raw").take(own), pa.array(number[at]), pa.array(start), pa.array(stop)],
                names=["h", "dead", "own", "raw", "at", "start", "stop"],
            )

    return run


def _open(batches):
    """Rows that have a window of RUN words not all of which are covered, with the seeds of those windows."""
    for batch in _slices(batches):
        _, at, row, low, _ = _windows(texts(batch), batch.column("covered"))
        if len(row):
            keep = np.unique(row)
            some = _seeds(at, row, low)
            edges = starts(np.bincount(row[some], minlength=batch.num_rows)[keep])
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), long_array(low[some]))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns, lists], names=[*batch.schema.names, "seeds"])


def _runs(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Runs of RUN words or more that occur twice, in the columns of the units; line is null."""
    spark = rows.sparkSession
    gone = units.where("removed").groupBy(F.col("doc_id").alias("id"), F.col("raw").alias("of")).agg(F.collect_list(F.struct("start", "stop", "lossy")).alias("gone"))
    near = rows.join(gone.hint("shuffle_hash"), (F.col("raw") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    spans = lambda c: F.transform(c, lambda g: F.struct(g["start"].alias("start"), g["stop"].alias("stop")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    near = near.select("doc_id", "raw", "text", F.coalesce(spans("gone"), none).alias("covered"), F.coalesce(spans(F.filter("gone", lambda g: g["lossy"])), none).alias("lossy"))
    span = "array<struct<start:bigint,stop:bigint>>"
    left = scratch(near.mapInArrow(_open, f"doc_id long, raw long, text string, covered {span}, lossy {span}, seeds array<long>"), "left")
    seeds = left.select(F.explode("seeds").alias("seed")).groupBy("seed").count().where("count > 1")
    held = spark.sparkContext.broadcast(Bitmap.collect(seeds, "seed"))
    windows = scratch(left.drop("seeds").mapInArrow(_candidates(held), "h long, dead boolean, own long, raw long, at long, start long, stop long"), "windows")
    discard(left)
    copies = windows.groupBy("h").agg(F.min(F.struct("dead", "own", "start", "raw")).alias("first"), F.count("*").alias("size")).where("size > 1 AND NOT first.dead")
    copies = scratch(copies, "copies")  # AQE splits a hot key of a join only where both sides are read as they were shuffled
    here = (F.col("first.own") == F.col("own")) & (F.col("first.raw") == F.col("raw"))
    found = windows.drop("dead").join(copies, "h")
    found = found.select(F.when(F.col("own") != _LAST, F.col("own")).alias("doc_id"), "raw", "at", "start", "stop", F.col("first.own").alias("keep"), F.col("first.raw").alias("keep_raw"), (F.col("start") - F.col("first.start")).alias("shift"), "size", here.alias("here"))
    # A window that overlaps the one it repeats is no second copy.
    found = found.where(~F.col("here") | (F.col("shift") == 0) | (F.abs("shift") >= F.col("stop") - F.col("start")))
    side = Window.partitionBy("doc_id", "raw", "keep", "keep_raw", "shift")
    apart = (F.col("at") > F.lag("at").over(side.orderBy("at")) + RUN).cast("int")
    found = found.withColumn("island", F.sum(F.coalesce(apart, F.lit(0))).over(side.orderBy("at")))
    runs = found.groupBy("doc_id", "raw", "keep", "keep_raw", "shift", "here", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("at") - F.min("at") + RUN).alias("n_words"), F.max("size").alias("cluster_size"))
    return runs.select(
        "doc_id", "raw", F.lit("run").alias("kind"), F.lit(None).cast("long").alias("line"), "start", (F.col("stop") - F.col("start")).alias("n_chars"), "n_words",
        F.when(F.col("keep") != _LAST, F.col("keep")).alias("keep_doc_id"), (F.col("start") - F.col("shift")).alias("keep_start"), "cluster_size", (~(F.col("here") & (F.col("shift") == 0))).alias("removed"),
    )


def _passing(held, column: str):
    """Rows whose 64-bit ``column`` is in a bitmap."""

    def run(batches):
        for batch in batches:
            at = np.flatnonzero(held.value.has(batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(at):
                yield batch.take(pa.array(at))

    return run


def _units_with_copies(rows: DataFrame, min_words: int) -> DataFrame:
    """Units of components of two or more: their place, the first of the component, removed, and lossy (removed for a near copy)."""
    spark = rows.sparkSession
    base = scratch(rows.mapInArrow(_units(min_words), _UNITS), "units")

    def sets_of(bitmap: Bitmap) -> DataFrame:
        held = spark.sparkContext.broadcast(bitmap)

        def fetch(batches):
            for batch in _slices(batches):
                u = _units_of(batch, min_words)
                rk = _row_keys(batch, u)
                at = np.flatnonzero(held.value.has(rk))
                if len(at):
                    s, n = shingle_sets(u["text"].take(pa.array(at)))
                    h1, h2 = set_hashes(s, n)
                    yield set_rows({"rk": rk[at], "h1": h1, "h2": h2}, s, n)

        return rows.mapInArrow(fetch, "rk long, h1 long, h2 long, body binary")

    def keys(reps: DataFrame) -> DataFrame:
        return reps.select("uid", F.explode("sig").alias("key")).select("key", "uid")

    units = base.where("n > 0 AND sig IS NOT NULL").withColumn("label", F.xxhash64("h1", "h2"))
    linked = near_duplicate_classes(units, keys, sets_of, PERCENT, BANDS).drop("group")
    classes = base.groupBy("h1", "h2").agg(F.count("*").alias("size"))
    named = classes.join(linked, ["h1", "h2"], "left").where("size > 1 OR comp IS NOT NULL").select("h1", "h2", F.coalesce("comp", F.xxhash64("h1", "h2")).alias("comp"))
    named = scratch(named, "classes")
    # Most units have no copy: the bitmap drops them before the join.
    held = spark.sparkContext.broadcast(Bitmap.collect(named, "h1"))
    narrow = base.drop("n", "sig", "rk")
    # A hot key's rows are split by AQE in this join and the next ones, as nothing behind them needs their partitioning.
    mine = narrow.mapInArrow(_passing(held, "h1"), narrow.schema).join(named, ["h1", "h2"])
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "start", (-F.col("n_chars")).alias("minus"), "raw", "h1", "h2").alias("place")  # of two that begin together the longer
    mine = scratch(mine.select("comp", "doc_id", "raw", "kind", "line", "start", "n_chars", "n_words", place), "mine")
    discard(base, named, linked)
    first = scratch(mine.groupBy("comp").agg(F.min("place").alias("first"), F.count("*").alias("size")).where("size > 1"), "first")
    within = lambda p: F.col("place.doc_id").eqNullSafe(p["doc_id"]) & (F.col("raw") == p["raw"]) & (F.col("start") >= p["start"]) & (F.col("start") + F.col("n_chars") <= p["start"] - p["minus"])
    apart = lambda p: ((F.col("place.h1") != p["h1"]) | (F.col("place.h2") != p["h2"])) & ~within(p)
    near = apart(F.col("first"))
    judged = mine.join(first, "comp").withColumn("stop", F.col("start") + F.col("n_chars"))
    around = Window.partitionBy("doc_id", "raw").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    dead = F.coalesce(F.max(F.when(near, F.col("stop"))).over(around) >= F.col("stop"), F.lit(False))
    judged = scratch(judged.select("*", F.struct(dead.alias("dead"), "place").alias("rank")).drop("first"), "judged")
    discard(mine)
    best = scratch(judged.groupBy("comp").agg(F.min("rank").alias("best")), "best")
    out = judged.join(best, "comp")
    # What lies within the passage that stays is no copy of it.
    out = out.where((F.col("place") == F.col("best.place")) | ~within(F.col("best.place")))
    removed = ~F.col("best.dead") & (F.col("place") != F.col("best.place"))
    near, keep = apart(F.col("best.place")), F.col("best.place.doc_id")
    out = scratch(
        out.select("doc_id", "raw", "kind", "line", "start", "stop", "n_chars", "n_words", F.when(keep != _LAST, keep).alias("keep_doc_id"), F.col("best.place.start").alias("keep_start"), F.col("size").alias("cluster_size"), removed.alias("removed"), (removed & near).alias("lossy")),
        "passages",
    )
    discard(judged, first, best)
    return out


def _distinct(rows: DataFrame) -> DataFrame:
    """One of rows equal in doc_id and text. Texts are only shuffled where there are such rows."""
    again = rows.groupBy("doc_id", "raw").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("raw").alias("of"))
    if again.isEmpty():
        return rows
    same = (F.col("raw") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
    one = rows.join(again, same, "left_semi").groupBy("doc_id", "raw", "text").count().drop("count")
    return rows.join(again, same, "left_anti").unionByName(one)


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """What ``repeated_paragraphs`` gives, with raw: 64 bits of the row's text."""
    rows = _distinct(named_rows(docs))
    units = _units_with_copies(rows, min_words)
    # Runs within a unit that is reported say nothing new.
    both = units.drop("stop", "lossy").unionByName(_runs(rows, units)).withColumn("stop", F.col("start") + F.col("n_chars"))
    before = Window.partitionBy("doc_id", "raw").orderBy("start", F.desc("stop"))
    of = lambda which: F.coalesce(F.max(F.when(which, F.col("stop"))).over(before), F.lit(-1))
    is_unit = F.col("kind") != "run"
    both = both.select("*", of(is_unit).alias("held"), of(is_unit & F.col("removed")).alias("gone"))
    left = both.where(is_unit | (F.col("stop") > F.when(F.col("removed"), F.col("gone")).otherwise(F.col("held"))))
    return left.drop("stop", "held", "gone")


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, kind, line, start, n_chars, n_words, keep_doc_id, keep_start, cluster_size, removed: passages that have a copy.

    ``docs`` has doc_id (long) and text; other columns are ignored. kind is
    line, paragraph (hard-wrapped lines; line is the first of them), sentence or
    run (line is null); start and n_chars are code points of the text as it is.
    One row for each unit of at least ``min_words`` words in a component of two or
    more, kept ones too, and for each run of RUN words or more that has a copy,
    unless it lies within such a unit (a removed run: within a removed one).
    Passages of one document may repeat each other. Null, empty and blank texts
    have none, an empty table gives none. A null doc_id ranks last. Rows equal in
    doc_id and text count as one text; rows that share a doc_id but not the text
    are told apart.
    """
    return passages(docs, min_words).drop("raw")


def remove_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and text of each row of ``docs`` without its removed passages; a removed line goes with its line feed.

    Rows are told apart by doc_id (null too) and text; rows equal in both are
    cut alike. A null text stays null, and a text without copies stays as it is.
    """
    gone = passages(docs, min_words).where("removed").groupBy(F.col("doc_id").alias("id"), F.col("raw").alias("of")).agg(F.sort_array(F.collect_set(F.struct("start", "n_chars", "kind"))).alias("gone"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(blank_text()).alias("raw"))
    rows = rows.join(gone, (F.col("raw") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "gone")

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if spans and text is not None:
                    parts, at = [], 0
                    for x in spans:
                        a, b = x["start"], x["start"] + x["n_chars"]
                        if x["kind"] in ("line", "paragraph"):
                            a, b = (a, b + 1) if b < len(text) else (max(0, a - 1), b)
                        parts.append(text[at : max(at, a)])
                        at = max(at, b)
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(cut, "doc_id long, text string")
