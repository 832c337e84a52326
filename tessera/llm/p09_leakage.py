"""Problem 9: evaluation passages inside training texts.

The n-grams of the held-out passages (default 12 words; a word is a run of letters or digits, case
does not count) are broadcast in blocks of about ``BLOCK_WORDS`` words, each a sorted array of hashes on the worker; a
larger test set is read block by block, each against the whole corpus. A text is split into words once; only
runs of n or more words that all occur in the passages can hold a hit, so most windows are never
built. Hits are looked up word for word, not by hash alone.

``found`` reports (doc_id, item_id), ``cleaned`` takes the leaked spans out of the texts.

Defined cases: null, empty and shorter texts and passages hold nothing; a passage that occurs in two
items is reported for both; repeated documents are each reported; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 12
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")


class Passages:
    """n-grams of a block of items: the words' numbers in one array, and the sorted hashes of all windows of n words with
    their places; about 20 bytes a word. A hash that meets is verified word for word."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n = n
        self.number: dict[str, int] = {}
        words, places, owner, at = [], [], [], 0
        for item, passage in items:
            w = [self.number.setdefault(x, len(self.number)) for x in WORD.findall(passage.lower())]
            words += w
            places += range(at, at + len(w) - n + 1)
            owner += [item] * max(0, len(w) - n + 1)
            at += len(w)
        self.words = np.array(words, np.int64)
        place = np.array(places, np.int64)
        hashes = self._hashes(self.words)[place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.place, self.owner = hashes[order], place[order], np.array(owner, np.int64)[order]

    def _hashes(self, words: np.ndarray) -> np.ndarray:
        """One hash for every window of n words."""
        size = len(words) - self.n + 1
        out = np.zeros(max(size, 0), np.uint64)
        for k in range(self.n if size > 0 else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + size].astype(np.uint64) + np.uint64(1)
            out ^= out >> np.uint64(29)
        return out

    def hits(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, word after the last, items) of every window that is an n-gram of an item."""
        number, n = self.number, self.n
        w = [number.get(x, -1) for x in WORD.findall(text.lower())]
        start = 0
        for end in [i for i, x in enumerate(w) if x < 0] + [len(w)]:
            if end - start >= n:
                run = np.array(w[start:end], np.int64)
                h = self._hashes(run)
                lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
                for i in np.flatnonzero(lo < hi):
                    met = [k for k in range(lo[i], hi[i]) if np.array_equal(self.words[self.place[k] : self.place[k] + n], run[i : i + n])]
                    if met:
                        yield start + int(i), start + int(i) + n, sorted({int(self.owner[k]) for k in met})
            start = end + 1


def _blocks(items: DataFrame, n: int):
    """Broadcast blocks of items, each of a bounded number of words."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("bigint"), "passage").filter("passage is not null")
    total = rows.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (BLOCK_WORDS * 4)))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast([tuple(r) for r in part.collect()])


def found(documents: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """doc_id, item_id of every document that holds n consecutive words of the item's passage."""

    def scan(held):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            passages = Passages(held.value, n)
            for pdf in batches:
                out = []
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    if text:
                        out += [(doc, i) for i in sorted({i for _, _, items in passages.hits(text) for i in items})]
                yield pd.DataFrame(out, columns=["doc_id", "item_id"])

        return run

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    return reduce(DataFrame.unionAll, [docs.mapInPandas(scan(h), "doc_id bigint, item_id bigint") for h in _blocks(items, n)])


def cleaned(documents: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_spans, clean_text of the affected documents: every leaked span, from its first to its
    last word, is cut out. One pass per block of items."""

    def scan(held):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            passages = Passages(held.value, n)
            for pdf in batches:
                out = []
                for doc, text, before in zip(pdf["doc_id"], pdf["text"], pdf["n_spans"], strict=True):
                    spans: list[list[int]] = []
                    for a, b, _ in passages.hits(text) if text else ():
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = b
                        else:
                            spans.append([a, b])
                    if spans:
                        # word positions hold in the text as stored unless lower case changes its length
                        at = [m.span() for m in WORD.finditer(text if len(text.lower()) == len(text) else text.lower())]
                        keep, last = [], 0
                        for a, b in spans:
                            keep.append(text[last : at[a][0]])
                            last = at[b - 1][1]
                        text = "".join([*keep, text[last:]])
                    out.append((doc, text, before + len(spans)))
                yield pd.DataFrame(out, columns=["doc_id", "text", "n_spans"])

        return run

    out = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("n_spans")).filter("text is not null")
    for held in _blocks(items, n):
        out = out.mapInPandas(scan(held), "doc_id bigint, text string, n_spans bigint")
    return out.filter("n_spans > 0").select("doc_id", "n_spans", F.col("text").alias("clean_text"))
