"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Every node has a failure link, the node reached after the pieces that
greedy longest match would cut off there have been cut, and the number of those pieces. A word
is then read once, byte by byte: where the trie has no way on, the count grows by the node's
number and the link is followed. No piece is ever built, and the time is linear in the text.

A word is a run of bytes other than ASCII white space, read with one space before it; pieces
that begin with a space thus only begin words. The byte vocabularies hold every single byte, so
every word can be cut. Null text has no words and no tokens; repeated rows and null ids are
counted like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
KEPT_WORDS = 400_000
LONG_WORD = 64


class Automaton:
    def __init__(self, vocabulary: Iterable[bytes]):
        """`way[node << 8 | byte]` is the next node; the root is 0."""
        self.way: dict[int, int] = {}
        ends = {0: False}
        parent: list[tuple[int, int]] = [(0, 0)]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                at = node << 8 | byte
                if at not in self.way:
                    self.way[at] = len(parent)
                    parent.append((node, byte))
                node = self.way[at]
            ends[node] = bool(piece)
        if missing := [b for b in range(256) if b not in self.way]:
            raise ValueError(f"the vocabulary lacks the single bytes {missing}")
        self.link, self.cut = [0] * len(parent), [0] * len(parent)
        # Parents first: shorter nodes are closed before longer ones.
        children: dict[int, list[int]] = {}
        for at, node in self.way.items():
            children.setdefault(at >> 8, []).append(node)
        queue = deque(children.get(0, []))
        while queue:
            node = queue.popleft()
            queue.extend(children.get(node, []))
            if ends.get(node):
                self.cut[node] = 1
                continue
            above, byte = parent[node]
            cut, to = self.cut[above], self.link[above]
            while to << 8 | byte not in self.way:
                cut, to = cut + self.cut[to], self.link[to]
            self.cut[node], self.link[node] = cut, self.way[to << 8 | byte]

    def count(self, word: bytes) -> int:
        """Pieces that greedy longest match cuts the word into."""
        way, link, cut = self.way, self.link, self.cut
        node = pieces = 0
        for byte in word:
            while (following := way.get(node << 8 | byte)) is None:
                pieces += cut[node]
                node = link[node]
            node = following
        while node:
            pieces += cut[node]
            node = link[node]
        return pieces


def read_vocabulary(path: str | None = None) -> list[bytes]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Counts(dict):
    """Counts of words seen; forgets all when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        count = self.automaton.count(b" " + word)
        if len(word) <= LONG_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = count
        return count


_counts: dict[str | None, Counts] = {}


def counts(path: str | None = None) -> Counts:
    """One per Python worker."""
    if path not in _counts:
        _counts[path] = Counts(Automaton(read_vocabulary(path)))
    return _counts[path]


def _count(path: str | None, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts(path).__getitem__
        for batch in batches:
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("_bytes")):
                words = (text.as_py() or b"").split()  # bytes split at ASCII white space only
                n_words[i], n_tokens[i] = len(words), sum(map(known, words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n_words), pa.array(n_tokens)], [*rest, "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, n_words, n_tokens)`, one row per row of `docs`."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.encode(text, "UTF-8").alias("_bytes"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_count(vocabulary, ["doc_id"]), f"doc_id {kind}, n_words long, n_tokens long")
