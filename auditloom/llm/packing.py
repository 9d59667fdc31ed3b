"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into whole sequences and a remainder. The remainders'
lengths form a histogram of at most 2047 bars, which is all that the driver
sees. A linear program chooses how often each pattern (lengths that share a
sequence) is used; a knapsack by dynamic programming prices new patterns with
its duals until none is worth adding. Whole uses are taken as they are, and the
few remainders left over by rounding are filled greedily.

Remainders are ranked within their length, and ranks are dealt to the uses of
the patterns by arithmetic alone. Patterns that leave room aren't padded: their
uses are laid end to end in one stream that is cut at each full sequence, so
only the stream's last sequence has padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, partition_uid, scratch, slices, starts, texts
from .wordcache import WordCache, coded_words

SEQUENCE = 2048
END = 1
#: Rows of the table for each task that ranks a length's rows, and such tasks at most (more rows then go to each).
RANKED, SALTS = 1_000, 1 << 16

# --- tokens -----------------------------------------------------------------

_PUNCTUATION = ".,;:!?"


class Tokens:
    """Ids of texts by ``tokenizers``; words are runs of [^\\x20\\x09-\\x0D], on which the tokenizer works one by one.

    Most words are encoded many to a call. An id that ends a word piece tells
    where each word's ids end, as a word of letters is one piece and one with
    stops after it is two; where the sum of ends is not as foreseen, and for
    all other words, each is encoded on its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.words = WordCache(self._encode)

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def _pieces(word: str) -> int:
        """Word pieces of words of letters with stops after them, 0 for other words."""
        core = word.rstrip(_PUNCTUATION)
        return 1 + (len(core) < len(word)) if core.isalpha() and "İ" not in core else 0

    def _encode(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        pieces = [self._pieces(w) for w in words]
        plain = [i for i, n in enumerate(pieces) if n]
        for a in range(0, len(plain), 512):
            some = plain[a : a + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in some])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([pieces[i] for i in some])
            if len(ends) == last[-1] and ends[-1] == len(ids):
                raw, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
                edges = [0, *(ends[last - 1] * width).tolist()]
                for i, x, y in zip(some, edges[:-1], edges[1:], strict=True):
                    out[i] = raw[x:y]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self._each([words[i] for i in rest]), strict=True):
                out[i] = x
        return out

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with END after each, ids of each text)."""
        distinct, codes, counts = coded_words(text)
        held = self.words(distinct)
        width = np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(held), self.kind)
        sizes = np.array([len(x) for x in held], np.int64) // width
        at = starts(sizes)[:-1]
        each = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        total = np.diff(starts(each)[starts(counts)])
        ids = np.full(int(each.sum()) + len(counts), END, self.kind)
        if len(each):
            place = np.arange(int(each.sum())) - np.repeat(starts(each)[:-1], each)
            owner = np.repeat(np.arange(len(counts)), total)
            ids[np.arange(len(owner)) + owner] = flat[np.repeat(at[codes], each) + place]
        return ids, total + 1


# --- plan -------------------------------------------------------------------


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity with unlimited pieces, and the last piece taken (-1: none, the unit before is free)."""
    by_length = np.full(capacity + 1, -1.0)
    by_length[lengths] = values
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        v = by_length[1 : c + 1] + best[c - 1 :: -1] if c > 1 else by_length[1:2] + best[:1]
        i = int(v.argmax())
        if v[i] > best[c - 1] + 1e-12:
            best[c], taken[c] = v[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, taken


def _greedy_start(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, np.ndarray]:
    """A basis of the master program: the longest length left with whatever is longest and fits, used until one of them runs out.

    Each pattern stands in the row of the length that it uses up. As no later
    pattern has that length, the basis is triangular; its inverse comes back too,
    by substitution.
    """
    m = len(lengths)
    left = demand.astype(float).copy()
    alive, order = list(range(m)), []
    sizes = lengths.tolist()
    basis: list[dict[int, int]] = [{} for _ in range(m)]
    uses = np.zeros(m)
    while alive:
        room, pattern, top = capacity, {}, len(alive)
        while top:
            i = alive[top - 1]
            if n := min(room // sizes[i], max(1, int(left[i]))):
                pattern[i] = n
                room -= n * sizes[i]
            top = min(top - 1, bisect_right(alive, room, key=lambda k: sizes[k]))
        n = min(left[i] / t for i, t in pattern.items())
        gone = min(pattern, key=lambda i: left[i] / pattern[i])
        for i, t in pattern.items():
            left[i] = max(0.0, left[i] - n * t)
        left[gone] = 0.0
        basis[gone], uses[gone] = pattern, n
        alive.remove(gone)
        order.append(gone)
    users: list[list[tuple[int, int]]] = [[] for _ in range(m)]  # earlier patterns that use a length
    for k in order:
        for i, t in basis[k].items():
            if i != k:
                users[i].append((k, t))
    inverse = np.zeros((m, m))
    for k in order:
        inverse[k, k] = 1.0
        for j, t in users[k]:
            inverse[k] -= t * inverse[j]
        inverse[k] /= basis[k][k]
    return basis, uses, inverse


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3, rounds: int = 200) -> list[tuple[dict[int, int], float]]:
    """Patterns {length: times} and their real-valued uses that cover ``demand`` with about the fewest sequences.

    Revised simplex on the master program from a greedy start. Ends when no
    pattern prices out, when the bound from the knapsack is within ``gap`` of
    the uses, or after so many ``rounds`` of pricing (what is then short of
    the best is room that the stream fills). The work is bounded by the
    number of lengths, not by that of documents.
    """
    m = len(lengths)
    index = {int(x): i for i, x in enumerate(lengths)}
    basis, x, inverse = _greedy_start(lengths, demand, capacity)
    y = inverse.sum(axis=0)
    for _ in range(rounds):
        best, taken = knapsack(y, lengths, capacity)
        if best[capacity] <= 1 + 1e-9 or x.sum() <= float(demand @ y) / best[capacity] * (1 + gap):
            break
        gain = y + best[capacity - lengths]
        changed = 0
        for i in np.argsort(-gain)[:32]:
            if gain[i] <= 1 + 1e-9 or changed == 8:
                break
            column: dict[int, int] = {int(i): 1}
            c = int(capacity - lengths[i])
            while c > 0:
                if taken[c] < 0:
                    c -= 1
                else:
                    j = index[int(taken[c])]
                    column[j] = column.get(j, 0) + 1
                    c -= int(taken[c])
            rows, times = np.array(list(column)), np.array(list(column.values()), float)
            if float(y[rows] @ times) <= 1 + 1e-9:
                continue
            d = (inverse[:, rows] * times).sum(axis=1)
            up = np.flatnonzero(d > 1e-9)
            if not len(up):
                continue
            ratio = x[up] / d[up]
            leave = int(up[int(ratio.argmin())])
            step = max(0.0, float(ratio.min()))
            used = np.flatnonzero(np.abs(d) > 1e-12)
            used = used[used != leave]
            live = np.flatnonzero(inverse[leave])
            row = inverse[leave, live] / d[leave]
            x[used] -= step * d[used]
            np.maximum(x, 0, out=x)
            reduced = 1.0 - float(y[rows] @ times)
            y[live] += reduced * row
            inverse[np.ix_(used, live)] -= np.outer(d[used], row)
            inverse[leave, live] = row
            x[leave], basis[leave] = step, column
            changed += 1
        if not changed:
            break
    return [({int(lengths[i]): n for i, n in p.items()}, float(v)) for p, v in zip(basis, x, strict=True) if v > 1e-9]


def fill(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Sequences for the few remainders that rounding leaves: the longest first, then whatever is longest and still fits."""
    lengths = sorted(k for k, v in left.items() if v)
    left = dict(left)
    out = []
    while lengths:
        room, pattern = capacity, {}
        while lengths and (i := bisect_right(lengths, room)):
            k = lengths[i - 1]
            pattern[k] = pattern.get(k, 0) + 1
            room -= k
            left[k] -= 1
            if not left[k]:
                del lengths[i - 1]
        out.append(pattern)
    return out


@dataclass
class Plan:
    """Where the piece of a length and rank goes; all arrays are of a size bounded by the sequence's length."""

    keys: np.ndarray  # length << 40 | first rank
    times: np.ndarray  # pieces of that length in a use of the pattern
    inner: np.ndarray  # offset of the first of them
    base: np.ndarray  # first sequence, or place in the stream
    width: np.ndarray  # of a use in the stream; 0: each use is a sequence
    stream: int  # first sequence of the stream
    sequences: int
    total: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece; in the stream it may reach over the sequence's end."""
        at = np.searchsorted(self.keys, (length << 40) | rank, "right") - 1
        k = rank - (self.keys[at] & ((1 << 40) - 1))
        use, slot = k // self.times[at], k % self.times[at]
        offset = self.inner[at] + slot * length
        along = self.base[at] + use * self.width[at] + offset
        streamed = self.width[at] > 0
        return np.where(streamed, self.stream + along // SEQUENCE, self.base[at] + use), np.where(streamed, along % SEQUENCE, offset)


def plan(histogram: dict[int, int]) -> Plan:
    """From the number of pieces of each length, 1 to SEQUENCE."""
    demand = {k: v for k, v in histogram.items() if v and k < SEQUENCE}
    uses: list[tuple[dict[int, int], int]] = [({SEQUENCE: 1}, histogram[SEQUENCE])] if histogram.get(SEQUENCE) else []
    if demand:
        lengths = np.array(sorted(demand))
        for pattern, n in column_generation(lengths, np.array([demand[k] for k in lengths.tolist()], float), SEQUENCE):
            whole = min([int(n + 1e-7), *(demand[k] // t for k, t in pattern.items())])
            if whole:
                uses.append((pattern, whole))
                for k, t in pattern.items():
                    demand[k] -= whole * t
        uses += [(p, 1) for p in fill(demand, SEQUENCE)]
    rank: dict[int, int] = {}
    rows, sequences, along = [], 0, 0
    for exact in (True, False):
        for pattern, n in uses:
            width = sum(k * t for k, t in pattern.items())
            if (width == SEQUENCE) != exact:
                continue
            inner = 0
            for k in sorted(pattern, reverse=True):
                first = rank.get(k, 0)
                rows.append((k << 40 | first, pattern[k], inner, sequences if exact else along, 0 if exact else width))
                rank[k] = first + n * pattern[k]
                inner += k * pattern[k]
            if exact:
                sequences += n
            else:
                along += n * width
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequences, sequences + -(-along // SEQUENCE), sequences * SEQUENCE + along)


# --- rows -------------------------------------------------------------------


def _pieces(vocabulary: str):
    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokens, take = Tokens(vocabulary), partition_uid()
        for batch in slices(batches, "text"):
            ids, counts = tokens(texts(batch))
            edges = starts(counts)
            doc, start, length, crc, body = [], [], [], [], []
            for i in range(len(counts)):
                own = ids[edges[i] : edges[i + 1]]
                wide = own.astype("<u4").tobytes()
                for a in range(0, len(own), SEQUENCE):
                    n = min(SEQUENCE, len(own) - a)
                    doc.append(i)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(wide[4 * a : 4 * (a + n)]))
                    body.append(own[a:].tobytes() if n < SEQUENCE else None)
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(at), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(counts).take(at), pa.array(body, pa.binary()), pa.array([tokens.kind().itemsize] * len(doc), pa.int32()), pa.array(take(len(doc)))],
                names=["doc_id", "start", "length", "crc", "doc_tokens", "ids", "width", "uid"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each row of ``docs``.

    ``docs`` has doc_id (long) and text; other columns are ignored. A null or
    empty text is the END id alone. Rows that repeat a doc_id are packed each
    for itself. An empty table gives no piece.
    """
    spark = docs.sparkSession
    pieces = scratch(only(docs, "doc_id", "text").mapInArrow(_pieces(vocabulary), "doc_id long, start long, length long, crc long, doc_tokens long, ids binary, width int, uid long"), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # 2048 rows at most
    chosen = spark.sparkContext.broadcast(plan(histogram))

    # Ranks within a length: salted by a row's own number, so that a length (or a row) which a third of all rows have is ranked by many tasks.
    salts = max(1, min(SALTS, sum(histogram.values()) // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("uid")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(sums, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = chosen.value.place(length, rank)
            start, crc = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "crc"))
            rows = np.arange(len(length))
            cut = np.flatnonzero(offset + length > SEQUENCE)
            if len(cut):  # in two: before and after the sequence's end
                head = SEQUENCE - offset[cut]
                rows = np.concatenate([rows, cut])
                parts = [batch.column("ids")[int(i)].as_py() for i in cut]
                widths = batch.column("width").take(pa.array(cut)).to_pylist()
                wide = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(parts, widths, strict=True)]
                crc = np.concatenate([crc, [zlib.crc32(x[4 * h :]) for x, h in zip(wide, head.tolist(), strict=True)]])
                crc[cut] = [zlib.crc32(x[: 4 * h]) for x, h in zip(wide, head.tolist(), strict=True)]
                start = np.concatenate([start, start[cut] + head])
                sequence, offset = np.concatenate([sequence, sequence[cut] + 1]), np.concatenate([offset, np.zeros(len(cut), np.int64)])
                length = np.concatenate([length, length[cut] - head])
                length[cut] = head
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), pa.array(start), pa.array(length), pa.array(crc.astype(np.int64)), batch.column("doc_tokens").take(at), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "start", "length", "crc", "doc_tokens", "ids", "width", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
