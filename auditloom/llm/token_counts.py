"""Numbers of word pieces by a linear longest-match automaton.

The vocabulary is a trie. A node that has no child for the next character
passes to its failure link: the node of what is left once the longest pieces
are taken off its string. How many pieces that takes is known beforehand, so
counting needs one step for each character and never builds a piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, starts, texts
from .wordcache import WordCache, coded_words

#: What begins a word in the vocabulary.
START = "▁"


class LongestMatch:
    """``pieces``: the vocabulary. A character that begins no piece counts as its UTF-8 bytes."""

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        weight = [0]  # pieces that a node's whole string stands for, 0 if it is none

        def node(text: str) -> int:
            at = 0
            for c in text:
                to = self.children[at].get(c)
                if to is None:
                    to = self.children[at][c] = len(self.children)
                    self.children.append({})
                    weight.append(0)
                at = to
            return at

        for p in pieces:
            if p:
                weight[node(p)] = 1
        for c in {c for n in list(self.children) for c in n}:  # so that every node can be taken apart
            if not weight[at := node(c)]:
                weight[at] = len(c.encode("utf-8", "surrogatepass"))
        self.link = [0] * len(self.children)
        self.popped = [0] * len(self.children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                queue.append(v)
                if weight[v]:
                    self.popped[v] = weight[v]
                    continue
                n, z = self.popped[u], self.link[u]
                while c not in self.children[z]:
                    n += self.popped[z]
                    z = self.link[z]
                self.link[v], self.popped[v] = self.children[z][c], n
        #: Pieces of all that is held at a node when the word ends.
        self.rest = [0] * len(self.children)
        queue = deque([0])
        while queue:  # links lead to shorter strings, which come first
            u = queue.popleft()
            queue.extend(self.children[u].values())
            if u:
                self.rest[u] = self.popped[u] + self.rest[self.link[u]]

    def count(self, word: str) -> int:
        children, link, popped = self.children, self.link, self.popped
        n = at = 0
        for c in word:
            to = children[at].get(c)
            while to is None and at:
                n += popped[at]
                at = link[at]
                to = children[at].get(c)
            if to is None:
                n += len(c.encode("utf-8", "surrogatepass"))
            else:
                at = to
        return n + self.rest[at]


def sentence_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens: one row for each row of ``docs`` (doc_id long, text; others are ignored).

    Words are runs of [^\\x20\\x09-\\x0D] with a START before each; each is cut
    greedily into the longest pieces. A null, empty or blank text has no tokens.
    """

    def run(batches):
        automaton = LongestMatch(sentence_pieces(vocabulary))
        cache = WordCache(lambda words: [automaton.count(START + w) for w in words])
        for batch in slices(batches, "text"):
            distinct, codes, counts = coded_words(texts(batch))
            each = np.array(cache(distinct), np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            total = starts(each)[starts(counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(np.diff(total))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
