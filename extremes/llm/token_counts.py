"""Greedy word-piece token counts by a linear longest-match automaton (operator 8).

The vocabulary is a trie over bytes with two roots: word-initial pieces hang from the root of words, the others from
the root of continuations. Every node has a failure link and the number of pieces that are popped when it is followed,
so one pass over a word's bytes gives its number of greedy longest-match pieces; the pieces are not built.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose count a worker remembers at most.
REMEMBERED = 500_000


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(word-initial pieces, continuation pieces) of a rank file; a leading blank marks the word-initial ones.

    The blank alone is the empty word-initial piece: a token for the start of words that no other one begins.
    """
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    first = [p[1:] for p in pieces if p[:1] == b" "]
    return first, [p for p in pieces if b" " not in p]


class Automaton:
    """Node 0 is the root of words, node 1 the root of continuations; edges are keyed by node * 256 + byte."""

    def __init__(self, first: list[bytes], rest: list[bytes]):
        edges: dict[int, int] = {}
        is_piece, parent, label = [False, False], [-1, -1], [0, 0]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in edges:
                        edges[key] = len(parent)
                        parent.append(node)
                        label.append(byte)
                        is_piece.append(False)
                    node = edges[key]
                is_piece[node] = True
        children: list[list[int]] = [[] for _ in parent]
        for node in range(2, len(parent)):
            children[parent[node]].append(node)
        fail, popped = [-1] * len(parent), [0] * len(parent)
        if is_piece[0]:  # the empty word-initial piece
            fail[0], popped[0] = 1, 1
        queue = deque(children[0] + children[1])
        while queue:  # by depth, so links lead to nodes already done
            node = queue.popleft()
            queue.extend(children[node])
            if is_piece[node]:
                fail[node], popped[node] = 1, 1
                continue
            up, n = fail[parent[node]], popped[parent[node]]
            while up >= 0 and (up << 8 | label[node]) not in edges:
                n += popped[up]
                up = fail[up]
            if up >= 0:
                fail[node], popped[node] = edges[up << 8 | label[node]], n
        self.keys = np.fromiter(edges, np.int64, len(edges))
        self.targets = np.fromiter(edges.values(), np.int32, len(edges))
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        self._ready: tuple | None = None
        self._seen: dict[str, int] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"} | {"_ready": None, "_seen": {}}

    def count(self, word: bytes) -> int:
        """Pieces of one word; a word that the vocabulary cannot cover is one unknown token."""
        if self._ready is None:
            self._ready = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True)), self.fail.tolist(), self.popped.tolist()
        edges, fail, popped = self._ready
        node, n = 0, 0
        for byte in word:
            while (to := edges.get(node << 8 | byte)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n

    def count_text(self, text: str | None) -> tuple[int, int]:
        """(words, tokens) of a whole text."""
        words = _WORD.findall(text) if text else []
        total, seen = 0, self._seen
        for w in words:
            n = seen.get(w)
            if n is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                n = seen[w] = self.count(w.encode("utf-8", "surrogatepass"))
            total += n
        return len(words), total


def with_token_counts(docs: DataFrame, automaton: Automaton, text: str = "text", out: str = "counted") -> DataFrame:
    """``docs`` with a struct ``out(n_words, n_tokens)``.

    Words are runs of characters other than white space. Null and wordless texts count 0; a word outside the vocabulary
    counts 1. Only ``text`` is read; repeated rows get equal counts, an empty table gives an empty one; other columns stay
    as they are, one with the name ``out`` is replaced.
    """

    @F.pandas_udf("n_words long, n_tokens long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([automaton.count_text(t) for t in part], columns=["n_words", "n_tokens"])

    return docs.withColumn(out, count(F.col(text)))
