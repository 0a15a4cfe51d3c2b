"""Token counts by a linear longest-match automaton (operator 1).

The vocabulary's tokens form a trie. A node that can't go on fails over: it pops the tokens that
greedy longest-match would have cut off by then, of which only the number is kept, and continues
at the node of what is left. So a word's number of pieces comes from one pass over its bytes and
no piece is ever built. Words are the matches of a pattern; each is cut by itself.

Defined cases: null text counts as empty; an empty text has 0 words and 0 tokens; repeated rows give
repeated results; other columns are passed by; an empty table gives no rows. The vocabulary must hold every byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from helixloom.llm.byte_bpe import read_ranks
from helixloom.llm.common import BoundedCache, text_slices, texts
from helixloom.llm.merges import NONE, PairTable


#: Bytes of a word beyond which steps over all words at once don't pay.
LONG = 1024


class LongestMatch:
    def __init__(self, vocabulary: Iterable[bytes], pattern: str):
        self.split = regex.compile(pattern).findall
        self.cache = BoundedCache()
        edges: dict[tuple[int, int], int] = {}
        token, parent, label, depth = [False], [0], [0], [0]
        for t in vocabulary:
            at = 0
            for c in t:
                to = edges.get((at, c))
                if to is None:
                    to = edges[at, c] = len(token)
                    token.append(False)
                    parent.append(at)
                    label.append(c)
                    depth.append(depth[at] + 1)
                at = to
            token[at] = token[at] or at > 0
        left, right = np.array(list(edges), np.int64).T
        self.edges = edges
        self.trie = PairTable(left, right, np.array(list(edges.values()), np.int32))
        #: Node to go on from after failing at a node, and how many tokens that pops. -1: no way on.
        self.fail, self.pops = np.full(len(token), -1, np.int64), np.zeros(len(token), np.int64)
        for v in np.argsort(depth, kind="stable").tolist()[1:]:
            if token[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            z, n = self.fail[parent[v]], self.pops[parent[v]]
            while z >= 0 and (z, label[v]) not in edges:
                n += self.pops[z]
                z = self.fail[z]
            self.fail[v], self.pops[v] = edges[z, label[v]] if z >= 0 else -1, n
        #: Tokens of all that a node stands for, at a word's end.
        self.rest = np.zeros(len(token), np.int64)
        for v in np.argsort(depth, kind="stable").tolist()[1:]:
            self.rest[v] = self.pops[v] + self.rest[self.fail[v]]
        self.steps: tuple[list[int], list[int]] | None = None

    def walk(self, word: bytes) -> int:
        """Number of greedy pieces of one word, byte by byte through the same automaton."""
        if self.steps is None:  # plain lists, made once: single look-ups in arrays are slow
            self.steps = self.fail.tolist(), self.pops.tolist()
        node, n, edges, (fail, pops) = 0, 0, self.edges, self.steps
        for c in word:
            while (to := edges.get((node, c))) is None:
                n += pops[node]
                node = fail[node]
            node = to
        return n + int(self.rest[node])

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Number of greedy pieces of each word: all words advance by a byte at a time; those beyond LONG bytes walk by themselves."""
        if any(len(w) > LONG for w in words):
            short = iter(self.lengths([w for w in words if len(w) <= LONG]).tolist())
            return np.array([next(short) if len(w) <= LONG else self.walk(w) for w in words], np.int64)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        raw, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        longer = len(words)
        for k in range(int(size.max(initial=0))):
            while longer and size[order[longer - 1]] <= k:
                longer -= 1
            todo = order[:longer]
            while todo.size:
                to = self.trie.find(node[todo], raw[start[todo] + k].astype(np.int64))
                on = to != NONE
                node[todo[on]] = to[on]
                todo = todo[~on]
                count[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
        return count + self.rest[node]

    def count(self, many: list[str]) -> list[tuple[int, int]]:
        split = [self.split(x) for x in many]
        if new := self.cache.new_of(split):
            self.cache.learn(new, self.lengths([w.encode() for w in new]).tolist())
        get = self.cache.__getitem__
        return [(len(x), sum(map(get, x))) for x in split]


@lru_cache(maxsize=2)
def automaton(path: str, pattern: str) -> LongestMatch:
    return LongestMatch(read_ranks(path), pattern)


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_words long, n_tokens long (greedy longest-match pieces of all words) for each row of `docs`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = automaton(path, pattern)
        for part in text_slices(batches):
            got = counter.count(texts(part))
            yield pa.record_batch([part.column("doc_id"), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
