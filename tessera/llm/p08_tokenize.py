"""Problem 8: token ids of every text by a public byte-level BPE vocabulary.

The merges are compiled into a deterministic automaton over tokens, one merge gadget after another.
It starts with one state per byte and every step allowed. The gadget of a merge (a, b) -> c takes the
step a-b away, gives the new state c the steps out of b and lets every state that steps to a step to
c as well. A token sequence is a path of the final automaton exactly if it is the BPE encoding of its
bytes, and since the automaton is deterministic a word has one such path. States share their steps:
a state keeps only the gadget that made it and the steps taken away later, each with its rank, so the
table has one entry per merge.

A word is read byte by byte through a transition table. A state holds what the rest of a word can depend on: the
node of the token trie (with failure links) for the longest end of the text that begins a token, and the last token of
the path at each place inside that end. A byte leads to one next state, whose last token is the longest token ending there
that the automaton lets follow the path before it. A transition is worked out once, when it is first met, and
then read from the table. The arcs' labels, walked back from the end, are the ids; their bytes, joined, are the word again.

Words come from the vocabulary's public split pattern. Files are a parameter (a folder), never
copied: each Python worker loads them once.

Defined cases: null, empty: an empty list; blank and very long texts are encoded whole; strings of
special tokens in a text are ordinary text; every row appears, repeated ids too.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
# Fixed value: the public split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 200_000
TABLE_ENTRIES = 2_000_000  # transitions held; then the table starts anew
CACHE_BYTES = 48


class Automaton:
    """The token automaton of a vocabulary given as {bytes: rank}; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.label = {i: t for t, i in ranks.items()}
        self.ranks = ranks
        self.removed: dict[tuple[int, int], int] = {}  # step -> rank of the gadget that took it away
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self.gadget(token, rank)
        self._trie()
        self._start()

    def gadget(self, token: bytes, rank: int) -> None:
        """Add the state of a merge. Its two parts are the path of the automaton built so far."""
        found = [(a, b) for k in range(1, len(token)) if (a := self.ranks.get(token[:k], rank)) < rank and (b := self.ranks.get(token[k:], rank)) < rank and self.steps(a, b, rank)]
        if len(found) != 1:
            raise ValueError(f"not a merge of two earlier tokens: {token!r}")
        a, b = found[0]
        self.removed[a, b] = rank
        self.left[rank], self.right[rank] = a, b

    def steps(self, a: int, b: int, before: int) -> bool:
        """Is there a step from state a to state b in the automaton before gadget ``before``?"""
        while True:
            if self.removed.get((a, b), before) < before:
                return False
            in_a, in_b = a in self.left, b in self.left
            if in_a and (not in_b or a > b):
                a, before = self.right[a], a  # the part's steps as they were then
            elif in_b:
                b, before = self.left[b], b + 1  # what steps to the part once a-b is gone
            else:
                return True

    def _trie(self) -> None:
        """Nodes are beginnings of tokens: child (node and byte to node), fail, the token that ends at a node (or -1), and
        the nearest node, itself or by failure links, at which one ends."""
        self.child: dict[int, int] = {}
        token, self.depth = [-1], [0]
        for t, rank in self.ranks.items():
            node = 0
            for c in t:
                key = node << 8 | c
                if key not in self.child:
                    self.child[key] = len(token)
                    token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]
            token[node] = rank
        self.token, self.fail = token, [0] * len(token)
        self.ends = [0] * len(token)
        for key, node in sorted(self.child.items(), key=lambda x: self.depth[x[1]]):
            parent, c = key >> 8, key & 255
            self.fail[node] = self._goto(self.fail[parent], c) if parent else 0
            self.ends[node] = node if token[node] >= 0 else self.ends[self.fail[node]]

    def _goto(self, node: int, c: int) -> int:
        while node and node << 8 | c not in self.child:
            node = self.fail[node]
        return self.child.get(node << 8 | c, 0)

    def _start(self) -> None:
        self.table: dict[int, int] = {}  # state and byte -> state
        self.number: dict[tuple[int, tuple[int, ...]], int] = {(0, (-1,)): 0}
        self.state, self.last = [(0, (-1,))], [-1]

    def transition(self, state: int, c: int) -> int:
        """The state after byte ``c``, entered into the table."""
        node, lasts = self.state[state]
        node = self._goto(node, c)
        at = self.ends[node]
        while True:
            if not at:
                raise ValueError(f"no token for byte {c}")
            t, before = self.token[at], lasts[-self.depth[at]]
            if before < 0 or self.steps(before, t, 1 << 60):
                break
            at = self.ends[self.fail[at]]
        new = (node, (*lasts, t)[-self.depth[node] - 1 :])
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.state)
            self.state.append(new)
            self.last.append(t)
        self.table[state << 8 | c] = number
        return number

    def path(self, word: bytes) -> list[int]:
        """Labels of the one path of ``word``."""
        if len(self.table) > TABLE_ENTRIES:
            self._start()
        table, last, state, read = self.table, self.last, 0, []
        for c in word:
            to = table.get(state << 8 | c)
            state = self.transition(state, c) if to is None else to
            read.append(last[state])
        out, i, label = [], len(read), self.label
        while i:
            t = read[i - 1]
            out.append(t)
            i -= len(label[t])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.label[i] for i in ids)


@lru_cache(maxsize=4)
def load(path: str) -> Automaton:
    with open(path, "rb") as f:
        return Automaton({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Encoder:
    """Texts to ids; words already met are kept up to a bound."""

    def __init__(self, path: str) -> None:
        import regex

        self.automaton, self.split, self.known = load(path), regex.compile(PATTERN), {}

    def word(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        out = self.automaton.path(data)
        if len(data) <= CACHE_BYTES:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[text] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for w in self.split.findall(text or ""):
            ids = known.get(w)
            out += self.word(w) if ids is None else ids
        return out


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """id_column and ids (array of int) of every row; one narrow pass in Arrow batches."""
    path = os.path.join(folder, vocabulary)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(df: DataFrame, id_column: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """id_column and text from ids: the inverse of ``encode`` (null and empty texts both give '')."""
    path = os.path.join(folder, vocabulary)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = load(path)
            yield pd.DataFrame({id_column: pdf[id_column], "text": [a.decode(list(x)).decode("utf-8", "replace") for x in pdf["ids"]]})

    return df.select(id_column, "ids").mapInPandas(run, f"`{id_column}` {kind}, text string")
