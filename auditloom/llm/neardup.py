"""Near-duplicate classes of sets of shingles: candidates by MinHash keys, links confirmed on full sets.

Shared by documents (``minhash_dedup``) and paragraphs (``substring_dedup``).
A unit is one set. Units with equal sets are one class from the start; only
the class's representative takes part in what follows.

Candidates of a key are linked to one hub, the least of the key, so a key with
n units gives n - 1 pairs and not n * n / 2. Links confirmed that way join
units into components. What is left to compare are units that share a hub but
are still in different components.

* Hubs of up to ``SPLIT`` units: those outside a hub's main component are compared
  with all of its units, in blocks of bounded size.
* Larger hubs, as of documents made from one template, are split first: each of
  their units gets FINE more keys of FINE_ROWS MinHash values, and the hub's
  units that share one are a smaller hub, treated likewise. A pair at 0.8
  shares one with probability 1 - (1 - 0.8 ** 5) ** 28 = 0.99998, a pair at 0.2
  with 0.009.

Only links that join something are written. So a large group of copies costs
one comparison for each copy, and no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, discard, long_array, mix, scratch, spread_join, starts
from .components import components

#: Units of a hub, and members of their sets, that one task compares with as many others.
BLOCK, BLOCK_MEMBERS = 2048, 4_000_000
#: Keys that split a larger hub, and MinHash values of each.
FINE, FINE_ROWS = 28, 5
#: Units from which a hub is split: comparing it in blocks copies its rows size / BLOCK times, splitting it FINE times.
SPLIT = FINE * BLOCK
#: Cells of a bit row that are compared in the time of counting one pair.
PAIR_COST = 256


def minhashes(shingles: np.ndarray, offsets: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` MinHash values of each set; shape (sets, n). Sets aren't empty."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.empty((len(offsets) - 1, n), np.uint64)
    at = 0
    while at < len(offsets) - 1:  # by blocks that stay in the cache
        to = min(max(int(np.searchsorted(offsets, offsets[at] + 65536)) - 1, at + 1), len(offsets) - 1)
        x = shingles[offsets[at] : offsets[to]]
        o = offsets[at:to] - offsets[at]
        for j in range(n):
            y = x * a[j]
            y += b[j]
            y ^= y >> np.uint64(29)
            out[at:to, j] = np.minimum.reduceat(y * np.uint64(0x94D049BB133111EB), o)
        at = to
    return out


def bands(values: np.ndarray, rows: int, tag: int) -> np.ndarray:
    """One 64-bit key for each ``rows`` neighbouring MinHash values, told apart by place and by ``tag``."""
    n = values.shape[1] // rows
    out = np.empty((len(values), n), np.uint64)
    for i in range(n):
        h = np.full(len(values), 0x9E3779B97F4A7C15 * (tag * 1000 + i + 1) & (1 << 64) - 1, np.uint64)
        for j in range(rows):
            h = mix(h ^ values[:, i * rows + j])
        out[:, i] = h
    return out


def _sorted_runs(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values`` with each run sorted; runs of one length are the rows of one matrix."""
    out = values.copy()
    at = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    lengths, first = np.unique(counts[order], return_index=True)
    for n, runs in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
        if n > 1:
            place = at[runs][:, None] + np.arange(n)
            out[place] = np.sort(values[place], axis=1)
    return out


def distinct_sets(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run, and how many."""
    owner = np.repeat(np.arange(len(counts)), counts)
    s = _sorted_runs(shingles, counts) if len(shingles) else shingles
    first = np.append(True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])) if len(s) else np.zeros(0, bool)
    return s[first], np.bincount(owner[first], minlength=len(counts)).astype(np.int64)


def set_hashes(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    h1, h2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        o = (np.cumsum(counts) - counts)[full]
        h1[full] = np.add.reduceat(mix(s ^ np.uint64(0xA0761D6478BD642F)), o)
        h2[full] = np.add.reduceat(mix(s ^ np.uint64(0xE7037ED1A0B428DB)), o)
    n = counts.astype(np.uint64)
    return mix(h1 + n), mix(h2 ^ mix(n))


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * common >= percent * union, of two sorted sets without repeats."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    common = int((q[at] == p).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def _linked(percent: int):
    def check(batches):
        for batch in batches:
            pairs = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            keep = [i for i, (x, y) in enumerate(pairs) if _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return check


def _finer(batches):
    """(uid, fine): the finer keys of each set."""
    for batch in batches:
        if batch.num_rows:
            bodies = batch.column("body").to_pylist()
            edges = np.concatenate([[0], np.cumsum([len(x) // 8 for x in bodies])])
            keys = bands(minhashes(np.frombuffer(b"".join(bodies), np.uint64), edges, FINE * FINE_ROWS, 17), FINE_ROWS, 7)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bodies) + 1, dtype=np.int32) * FINE), long_array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), lists], names=["uid", "fine"])


def _within(percent: int):
    """Links across components among the units of one hub, of one block of targets and one of queries.

    Only links that join what is still apart here are given, so a dense group
    gives a forest and not all its pairs.
    """

    def links(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        uid, comp, side = (rows.column(c).to_numpy() for c in ("uid", "comp", "side"))
        bodies = [np.frombuffer(x, np.uint64) for x in rows.column("body").to_pylist()]
        n = np.array([len(x) for x in bodies])
        targets, queries = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        common = _intersections(bodies, queries, targets)
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for k, i in enumerate(queries):
            c = common[k]
            some = np.flatnonzero((comp[targets] != comp[i]) & (100 * c >= percent * (n[targets] + n[i] - c)))
            for j in targets[some]:
                p, q = find(int(comp[i])), find(int(comp[j]))
                if p != q:
                    root[p] = q
                    found.append((min(uid[i], uid[j]), max(uid[i], uid[j])))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return links


def _intersections(bodies: list[np.ndarray], queries: np.ndarray, targets: np.ndarray, width: int = 1 << 15, pairs: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of each query with each target.

    Values that few hold are counted pair by pair of their holders (``pairs`` at
    a time), the others on bit rows over ``width`` values at a time.
    """
    out = np.zeros((len(queries), len(targets)), np.int64)
    if not len(queries) or not len(targets):
        return out
    of = lambda some: (np.concatenate([bodies[i] for i in some]), np.repeat(np.arange(len(some)), [len(bodies[i]) for i in some]))
    (left, k), (right, j) = of(queries), of(targets)
    values, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = codes[: len(left)], codes[len(left) :]
    n_left, n_right = (np.bincount(x, minlength=len(values)) for x in (left, right))
    holders = n_left * n_right
    often = holders * PAIR_COST > out.size

    order = np.argsort(right, kind="stable")
    held, first = j[order], starts(n_right)
    rare = (holders > 0) & ~often
    some = np.flatnonzero(rare[left])
    n = n_right[left[some]]
    edges = starts(n)
    at = 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + pairs, "right")) - 1)
        mine, m = some[at:stop], n[at:stop]
        place = np.repeat(first[left[mine]] - edges[at:stop], m) + np.arange(edges[at], edges[stop])
        low, high = int(k[mine[0]]), int(k[mine[-1]]) + 1  # a body's members stand together
        cells = np.bincount(np.repeat(k[mine] - low, m) * len(targets) + held[place], minlength=(high - low) * len(targets))
        out[low:high] += cells.reshape(high - low, -1)
        at = stop

    code = np.cumsum(often) - 1
    for low in range(0, int(often.sum()), width):
        words = (min(width, int(often.sum()) - low) + 63) // 64

        def bits(members: np.ndarray, owner: np.ndarray, rows: int, low: int = low, words: int = words) -> np.ndarray:
            keep = often[members] & (code[members] >= low) & (code[members] < low + width)
            at = code[members[keep]] - low
            grid = np.zeros((rows, words), np.uint64)
            np.bitwise_or.at(grid, (owner[keep], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            return grid

        mine, theirs = bits(left, k, len(queries)), bits(right, j, len(targets))
        for i in np.flatnonzero(mine.any(axis=1)):
            out[i] += np.bitwise_count(theirs & mine[i]).sum(axis=1, dtype=np.int64)
    return out


def near_duplicate_classes(units: DataFrame, keys: Callable[[DataFrame], DataFrame], sets_of: Callable[[Bitmap], DataFrame], percent: int, width: int) -> DataFrame:
    """(h1, h2, group, comp): for each distinct set that is linked with another, its component and the component's least label.

    ``units``: a scratch table with h1, h2 (the set's name), n (its size, over
    0), label (long; the least of a component is what comes back), rk (a
    row's 64-bit key for ``sets_of``) and sig (array of ``width`` longs: its bands).
    ``keys`` explodes (uid, n, sig) into rows (key, uid). ``sets_of`` gives
    (rk, h1, h2, body) of at least the rows whose rk is in the bitmap. Sets are
    linked if 100 * common >= percent * union. group is a 64-bit name.
    """
    # Equal sets have equal bands; as single longs they are aggregated by hash, where an array or struct would be sorted.
    sig = [F.first(F.col("sig")[i]).alias(f"s{i}") for i in range(width)]
    reps = units.groupBy("h1", "h2").agg(F.min("label").alias("label"), F.min("rk").alias("rk"), F.first("n").alias("n"), *sig)
    reps = scratch(reps.select("h1", "h2", "label", "rk", "n", F.array(*[f"s{i}" for i in range(width)]).alias("sig"), F.xxhash64("h1", "h2").alias("uid")), "reps")
    keyed = keys(reps.select("uid", "n", "sig"))
    hubs = keyed.groupBy("key").agg(F.min("uid").alias("hub"), F.count("*").alias("size")).where("size > 1")
    stars = scratch(keyed.join(hubs, "key").where("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct(), "stars")

    ends = stars.select(F.col("a").alias("uid")).union(stars.select(F.col("b").alias("uid"))).distinct()
    members = scratch(reps.join(ends, "uid", "left_semi").select("uid", "rk", "h1", "h2", "n"), "members")
    bitmap = Bitmap.collect(members, "rk")
    found = sets_of(bitmap).join(members.select("uid", "rk", "h1", "h2"), ["rk", "h1", "h2"]).groupBy("uid").agg(F.first("body").alias("body"))
    sets = scratch(found, "sets")
    sizes = members.select("uid", "n")

    def confirmed(pairs: DataFrame) -> DataFrame:
        fit = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
        both = fit.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
        return both.select("a", "b", "sa", "sb").mapInArrow(_linked(percent), "a long, b long")

    def still_open(near: DataFrame) -> DataFrame:
        """Units (hub, uid, comp) of hubs that hold several components, with main (its largest), size, ps and qs (blocks of either side)."""
        near = near.join(sizes, "uid")
        each = near.groupBy("hub", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("members"))
        most = each.groupBy("hub").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("size"), F.sum("members").alias("members")).where("size > most.n")
        parts = lambda n: F.ceil(F.greatest(n / BLOCK, n / F.col("size") * F.col("members") / BLOCK_MEMBERS)).cast("int")
        figures = most.select("hub", F.col("most.comp").alias("main"), "size", parts(F.col("size")).alias("ps"), parts(F.col("size") - F.col("most.n")).alias("qs"))
        return scratch(spread_join(near.drop("n"), figures, ["hub"], "uid"), "open")

    def of_stars(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        rows = pairs.select(F.col("a").alias("hub"), F.col("b").alias("uid"))
        return rows.join(comps.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid")).select("hub", "uid", "comp")

    def compared(rest: DataFrame) -> DataFrame:
        # Targets: all units of the hub; queries: those outside its main component. Either side is cut into blocks.
        own = F.xxhash64("uid", "hub")
        targets = rest.select("hub", F.pmod(own, F.col("ps")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "uid", "comp", F.lit(0).alias("side"))
        queries = rest.where("comp <> main").select("hub", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), F.pmod(own, F.col("qs")).cast("int").alias("q"), "uid", "comp", F.lit(1).alias("side"))
        dealt = targets.unionByName(queries).join(sets, "uid")
        return dealt.groupBy("hub", "p", "q").applyInArrow(_within(percent), "a long, b long")

    links = scratch(confirmed(stars), "links")
    comps = components(links)
    # Units that share a key share its hub, and each has been compared with that. What is still apart is compared hub by hub.
    rest = still_open(of_stars(stars, comps))
    large = rest.where(F.col("size") > SPLIT)
    if not large.isEmpty():
        fine = scratch(sets.join(large.select("uid").distinct(), "uid").mapInArrow(_finer, "uid long, fine array<long>"), "fine")
        split = large.select("hub", "uid", "comp").join(fine, "uid").select(F.explode("fine").alias("f"), "hub", "uid", "comp").select(F.xxhash64("hub", "f").alias("key"), "uid", "comp")
        inner = split.groupBy("key").agg(F.min("uid").alias("hub"), (F.min("comp") != F.max("comp")).alias("several")).where("several").drop("several")
        pairs = scratch(split.join(inner, "key").where("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct(), "stars")
        links = scratch(links.union(confirmed(pairs)), "links")
        comps = components(links)
        small, inside = rest.where(F.col("size") <= SPLIT).select("hub", "uid"), of_stars(pairs, comps)
        # Small hubs are held against the new components, too.
        again = small.join(comps.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid")).select("hub", "uid", "comp")
        rest = still_open(again.unionByName(inside.withColumn("hub", F.xxhash64("hub", F.lit("fine")))))
    if not rest.isEmpty():
        more = scratch(compared(rest), "links")
        if not more.isEmpty():
            comps = components(links.union(more))
    named = comps.join(reps.select(F.col("uid").alias("node"), "h1", "h2", "label"), "node")
    out = scratch(named.join(named.groupBy("comp").agg(F.min("label").alias("least")), "comp").select("h1", "h2", F.col("comp").alias("group"), F.col("least").alias("comp")), "named")
    discard(stars, members, sets, rest, reps, links)
    return out


def set_rows(names: dict[str, np.ndarray], values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows with the bytes of each set as ``body``."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    raw = values.tobytes()
    body = pa.array([raw[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([*(long_array(v) for v in names.values()), body], names=[*names, "body"])
