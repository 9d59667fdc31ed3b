"""Language identification by unigrams summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words. The probabilities
are learned by expectation maximisation, which uses the same sums.

Words are runs of [^\\x20\\x09-\\x0D] in lower case (Unicode), for learning as for
prediction. No word is cut: those of up to SHORT characters are summed many at
once in plain floats, longer ones (as of scripts without blanks) one by one in
logarithms, over all their segmentations alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_rows, named_rows, slices, texts
from .token_counts import START, sentence_pieces
from .wordcache import WordCache, coded_words

#: The only bound: distinct rows of each language that are learned from. Predictions cover all rows.
SAMPLE = 300
ROUNDS = 2
UNDETERMINED = "und"
#: A character that no piece covers, and a piece that a language never showed.
UNKNOWN, FLOOR = 1e-7, 1e-9
#: Characters up to which no product of probabilities leaves the range of floats.
SHORT = 32
#: Bytes of text that are scored at a time.
SLICE = 2 << 20


@dataclass
class Model:
    """``probability``: a row for each piece, a column for each language."""

    languages: list[str]
    pieces: list[str]
    probability: np.ndarray

    @staticmethod
    def of(languages: list[str], pieces: dict[str, tuple[float, ...]]) -> Model:
        return Model(languages, list(pieces), np.array(list(pieces.values()), np.float64).reshape(len(pieces), len(languages)))


class Trie:
    """Pieces as a table of steps; all words take the same step together, so a step is a few array operations."""

    #: Entries of a dense table of steps; a larger trie is searched instead.
    DENSE = 1 << 24

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        chars = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for k, p in enumerate(pieces):
            at = 0
            for c in self.code[[ord(c) for c in p]].tolist():
                to = children[at].get(c)
                if to is None:
                    to = children[at][c] = len(children)
                    children.append({})
                    piece.append(-1)
                at = to
            piece[at] = k
        self.piece = np.array(piece)
        steps = sorted((n * self.width + c, to) for n, edges in enumerate(children) for c, to in edges.items())
        keys, to = np.array([k for k, _ in steps], np.int64), np.array([t for _, t in steps], np.int64)
        self.dense = None
        if len(children) * self.width <= self.DENSE:
            self.dense = np.zeros(len(children) * self.width, np.int32)
            self.dense[keys] = to
        self.keys, self.to = np.append(keys, np.iinfo(np.int64).max), np.append(to, 0)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next node, 0 if there is none."""
        key = state * self.width + code
        if self.dense is not None:
            return self.dense[key].astype(np.int64)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], 0)

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, length, piece) of all pieces in a row of characters, and of every single character (piece -1 if it is none).

        ``room``: how many characters of its word each place has before it, itself included.
        """
        at = np.arange(len(codes))
        state = np.zeros(len(codes), np.int64)
        first, length, found = [], [], []
        for n in range(1, self.longest + 1):
            if n > 1:
                fits = room[at] >= n
                at, state = at[fits], state[fits]
            state = self.step(state, codes[at + n - 1])
            piece = np.where(state > 0, self.piece[state], -1)
            take = np.ones(len(at), bool) if n == 1 else piece >= 0
            first.append(at[take])
            length.append(np.full(int(take.sum()), n))
            found.append(piece[take])
            live = state > 0
            at, state = at[live], state[live]
            if not len(at):
                break
        return np.concatenate(first), np.concatenate(length), np.concatenate(found)


def _log_sums(source: np.ndarray, target: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Log sums over all paths from place 0 to each of 0..n; edges sorted by target, ``weights`` their logs by column."""
    out = np.full((n + 1, weights.shape[1]), -np.inf)
    out[0] = 0.0
    edges = np.searchsorted(target, np.arange(n + 2))
    for j in range(1, n + 1):
        a, b = edges[j], edges[j + 1]
        v = out[source[a:b]] + weights[a:b]
        m = v.max(axis=0)
        out[j] = m + np.log(np.exp(v - m).sum(axis=0))
    return out


class Scorer:
    """Log probabilities of words in each language, summed over all segmentations."""

    CHUNK = 8192

    def __init__(self, model: Model):
        self.n_lang, self.trie = len(model.languages), Trie(model.pieces)
        self.longest, self.probability = self.trie.longest, model.probability
        self.logs = np.log(np.concatenate([model.probability, np.full((1, self.n_lang), UNKNOWN)]))  # the last: no piece

    def __call__(self, words: list[str]) -> list[list[float]]:
        marked = [START + w for w in words]
        sizes = np.array([len(w) for w in marked], np.int64)
        out = np.zeros((len(words), self.n_lang))
        order = np.flatnonzero(sizes <= SHORT)
        order = order[np.argsort(-sizes[order], kind="stable")]
        for low in range(0, len(order), self.CHUNK):
            some = order[low : low + self.CHUNK]
            out[some] = self._short([marked[i] for i in some], sizes[some])
        for i in np.flatnonzero(sizes > SHORT):
            out[i] = self._long(marked[i])
        return out.tolist()

    def _long(self, text: str) -> np.ndarray:
        codes = self.trie.codes(text)
        first, length, piece = self.trie.edges(codes, np.arange(len(codes), 0, -1))
        order = np.argsort(first + length, kind="stable")
        return _log_sums(first[order], (first + length)[order], self.logs[piece[order]], len(codes))[-1]

    def _short(self, parts: list[str], sizes: np.ndarray) -> np.ndarray:
        """``parts`` by falling length."""
        n, longest = len(parts), int(sizes[0])
        flat = self.trie.codes("".join(parts))
        codes = np.zeros((longest, n), np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes[place, np.repeat(np.arange(n), sizes)] = flat
        over = np.array([int((sizes >= j).sum()) for j in range(longest + 1)])  # words of at least j characters come first
        forward = np.zeros((longest + 1, n, self.n_lang))
        forward[0] = 1.0
        for i in range(longest):
            at = np.arange(over[i + 1])
            state = np.zeros(len(at), np.int64)
            for j in range(i + 1, min(longest, i + self.longest) + 1):
                if j > i + 1:
                    keep = at < over[j]
                    at, state = at[keep], state[keep]
                state = self.trie.step(state, codes[j - 1, at])
                piece = np.where(state > 0, self.trie.piece[state], -1)
                full = piece >= 0
                if j == i + 1:
                    p = np.full((len(at), self.n_lang), UNKNOWN)
                    p[full] = self.probability[piece[full]]
                    forward[j, at] += forward[i, at] * p
                elif full.any():
                    forward[j, at[full]] += forward[i, at[full]] * self.probability[piece[full]]
                live = state > 0
                at, state = at[live], state[live]
                if not len(at):
                    break
        return np.log(forward[sizes, np.arange(n)])


class Lattice:
    """All segmentations of some words, as edges over one row of places (a word of n characters has n + 1)."""

    def __init__(self, trie: Trie, words: list[str], times: np.ndarray):
        marked = [START + w for w in words]
        sizes = np.array([len(w) for w in marked], np.int64)
        codes = trie.codes("".join(marked))
        word = np.repeat(np.arange(len(words)), sizes)
        edge = np.cumsum(sizes)
        first, length, self.piece = trie.edges(codes, np.repeat(edge, sizes) - np.arange(len(codes)))
        self.word = word[first]
        self.start = first + self.word  # one more place for each word before it
        self.end = self.start + length
        self.last = edge + np.arange(len(words))
        self.zero = np.append(0, self.last[:-1] + 1)
        self.step = first - (edge - sizes)[self.word]  # place of the edge's start in its word
        self.times, self.places, self.longest = times, int(edge[-1] + len(words)) if len(words) else 0, int(sizes.max(initial=0))

    def expected(self, probability: np.ndarray, unknown: float = UNKNOWN) -> np.ndarray:
        """Expected number of each piece over all segmentations, weighted by the words' times; logs throughout, as words may be long."""
        with np.errstate(divide="ignore"):
            weight = np.log(np.append(probability, unknown))[self.piece]
        single = (self.end - self.start == 1) & ~np.isfinite(weight)
        weight[single] = np.log(unknown)
        live = np.isfinite(weight)
        start, end, weight, piece, word, step = self.start[live], self.end[live], weight[live], self.piece[live], self.word[live], self.step[live]
        forward, backward = np.full(self.places, -np.inf), np.full(self.places, -np.inf)
        forward[self.zero] = 0.0
        backward[self.last] = 0.0
        order = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[order], np.arange(self.longest + 1))
        for i in range(self.longest):
            e = order[cuts[i] : cuts[i + 1]]
            np.logaddexp.at(forward, end[e], forward[start[e]] + weight[e])
        for i in range(self.longest - 1, -1, -1):
            e = order[cuts[i] : cuts[i + 1]]
            np.logaddexp.at(backward, start[e], weight[e] + backward[end[e]])
        share = np.exp(forward[start] + weight + backward[end] - forward[self.last][word]) * self.times[word]
        known = piece >= 0
        return np.bincount(piece[known], share[known], len(probability))


def train(words: dict[str, dict[str, int]], vocabulary: Iterable[str], rounds: int = ROUNDS) -> Model:
    """From the words of each language (in lower case) and how often they occur. START stands before each word."""
    known = sorted({p.lower() for p in vocabulary if p})
    trie = Trie(known)
    languages = sorted(words)
    table = np.zeros((len(known), len(languages)))
    for k, language in enumerate(languages):
        own = sorted(words[language])
        lattice = Lattice(trie, own, np.array([words[language][w] for w in own], np.float64))
        # Every piece starts by its share of all occurrences, whatever the segmentation.
        here = lattice.piece >= 0
        p = np.bincount(lattice.piece[here], lattice.times[lattice.word[here]], len(known))
        p /= p.sum() or 1.0
        for _ in range(rounds):
            p = lattice.expected(p)
            p /= p.sum() or 1.0
            p[p <= FLOOR] = 0.0
        table[:, k] = p
    shown = np.flatnonzero(table.any(axis=1))
    return Model(languages, [known[i] for i in shown], np.maximum(table[shown], FLOOR))


def sample_words(rows: DataFrame, per_language: int = SAMPLE) -> dict[str, dict[str, int]]:
    """How often each word occurs in at most ``per_language`` distinct rows of each language, the least by a hash.

    First the rows of each language are counted, map-side; a row goes on if its
    hash is below what about twice as many rows as wanted have, so no language is
    gathered. Rows equal in doc_id and text count once. What reaches the driver
    are the distinct words of the sample.
    """
    keyed = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    total = rows.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("total"))
    below = keyed.join(total, "lang").where(F.col("h") / float(1 << 64) + 0.5 <= (2.0 * per_language + 40.0) / F.col("total"))
    once = below.groupBy("lang", "h").agg(F.first("text").alias("text"))
    some = once.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)

    def count(batches):
        for batch in slices(batches, "text"):
            distinct, codes, counts = coded_words(pc.utf8_lower(texts(batch)))
            owner = np.repeat(np.arange(len(counts)), counts)
            pairs, times = np.unique(owner * max(1, len(distinct)) + codes, return_counts=True)
            at, word = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(at)), pa.array([distinct[i] for i in word], pa.string()), pa.array(times)], names=["lang", "word", "times"])

    counted = some.select("lang", "text").mapInArrow(count, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    out: dict[str, dict[str, int]] = {r.lang: {} for r in total.select("lang").collect()}
    for r in counted.toLocalIterator():
        out[r.lang][r.word] = r.times
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, raw, lang_pred, score: from text alone, one row for each row of ``docs`` (doc_id long, text; others are ignored).

    raw is 64 bits of the text. score is the language's share among the
    languages' probabilities. A text that is null or has no letter is ``und``
    with score 0, and so is any text if there is no language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        n_lang = len(model.languages)
        names = np.array([*model.languages, UNDETERMINED], object)
        cache = WordCache(Scorer(model), 150_000)
        for batch in slices(batches, "text", SLICE):
            text = pc.utf8_lower(texts(batch))
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            best, score = np.full(len(text), n_lang), np.zeros(len(text))
            distinct, codes, counts = coded_words(text)
            if n_lang and len(codes):
                logs = np.array(cache(distinct), np.float64)
                owner = np.repeat(np.arange(len(counts)), counts)
                sums = np.stack([np.bincount(owner, logs[codes, k], len(counts)) for k in range(n_lang)], axis=1)
                sums -= sums.max(axis=1, keepdims=True)
                share = np.exp(sums)
                share /= share.sum(axis=1, keepdims=True)
                best[letters], score[letters] = share.argmax(axis=1)[letters], share.max(axis=1)[letters]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "raw", "lang_pred", "score"])
        pa.default_memory_pool().release_unused()  # workers wait for other stages beside the ones that run

    return named_rows(docs).mapInArrow(run, "doc_id long, raw long, lang_pred string, score double")


def held_out():
    """True for the rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def train_on(docs: DataFrame, vocabulary: str, per_language: int = SAMPLE) -> Model:
    """Learns from text and lang of the rows of ``docs`` that aren't held out."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out())
    return train(sample_words(rows, per_language), sentence_pieces(vocabulary))


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, by a model learned from the rows that aren't held out.

    ``docs`` has doc_id (long), text and lang; other columns are ignored. Rows
    without lang or text teach nothing; a null doc_id isn't held out, and rows
    that repeat a doc_id are judged by their own texts. Without any labelled row,
    and for texts that are null or have no letter, lang_pred is ``und`` with
    score 0. An empty table gives an empty result. Of the model only the pieces
    that the sample shows are broadcast, with a figure for each language: it
    grows with the number of distinct ``lang`` values, not with the rows.
    """
    return predict(docs, train_on(docs, vocabulary)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letters, or a share under ``least``.

    Rows are told apart by doc_id (null too) and text; a null text goes. All
    columns come back, whatever their names.
    """
    judged = predict(docs, train_on(docs, vocabulary))
    return drop_rows(docs, judged.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least)).select("doc_id", "raw"))
