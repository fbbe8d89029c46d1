"""Benchmark decontamination with suffix arrays of the training text.

Documents are cut into shards of a few megabytes. A shard's words become
numbers (those of the benchmark's words; all others are one number that matches
nothing), and its suffix array holds the word positions in the order of the
text that follows them, compared to window depth. Every benchmark window is binary-searched in it; equal
neighbours give all places of a window, and windows that follow each other in
both texts join to the longest verbatim match.

Positions whose next words cannot begin any window are left out of the array:
this drops no match. Word numbers come from 64-bit hashes; each match is
compared byte by byte before it counts.

The benchmark goes to the executors in blocks of bounded size; a benchmark of
more than one block takes a pass over the documents for each, without shuffle.
Documents are never shuffled at all.

Defined results: a null or wordless text has no words and is clean; a null or
wordless item has no window; repeated items count each on its own, as do
repeated documents; an empty table on either side leaves all documents clean;
a null item_id is skipped in the list of items but hits all the same. Columns
of ``mark`` stand behind all columns of the documents, whose names may be any
but its own four, prefixed ``bd_``.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.arrow import add_columns, text_bytes
from readloom.llm.words import WordText

class Block:
    """The windows of a block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        self.size = size
        texts = [(t or "").encode() for _, t in items]
        text = WordText(b"".join(texts), [len(t) for t in texts])
        self.item_ids = [i for i, _ in items]
        self.known, first, number = np.unique(text.hash, return_index=True, return_inverse=True)
        self.words = np.array([text.word(i) for i in first], dtype=object)
        if any(text.word(i) != self.words[k] for i, k in enumerate(number)):
            raise ValueError("two benchmark words have the same hash")
        number = number.astype(np.int64) + 1
        places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for i in range(len(items)):
            a, b = int(text.first[i]), int(text.first[i + 1])
            own = number[a:b].tolist()
            for k in range(max(1, len(own) - size + 1) if own else 0):
                places[tuple(own[k : k + size])].append((i, k))
        self.windows = list(places)
        self.places = [places[w] for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.shortest = int(self.length.min()) if self.windows else 0
        heads = min(self.shortest, 3)
        self.heads = [np.unique([self._key(w[: k + 1]) for w in self.windows]) for k in range(1, heads)] if heads > 1 else []
        self.firsts = np.zeros(len(self.known) + 2, dtype=bool)
        self.firsts[[w[0] for w in self.windows]] = True

    def _key(self, numbers) -> int:
        out = 0
        for x in numbers:
            out = out * (len(self.known) + 2) + int(x)
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words that the block has not."""
        if not len(self.known):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)


class SuffixArray:
    """Word positions of a shard in the order of the words that follow them."""

    def __init__(self, numbers: np.ndarray, first: np.ndarray, block: Block):
        self.depth = block.size
        n = len(numbers)
        padded = np.concatenate([numbers, np.zeros(self.depth, dtype=np.int64)])
        last = np.repeat(first[1:], np.diff(first))  # where each word's text ends
        at = np.arange(n)
        keep = np.flatnonzero(block.firsts[numbers] & (at + block.shortest <= last))
        for k, heads in enumerate(block.heads, start=2):
            if not len(keep):
                break
            key = padded[keep]
            for j in range(1, k):
                key = key * (len(block.known) + 2) + padded[keep + j]
            slot = np.minimum(np.searchsorted(heads, key), len(heads) - 1)
            keep = keep[heads[slot] == key]
        table = np.empty((len(keep), self.depth), dtype=">u4")
        for j in range(self.depth):
            table[:, j] = np.where(keep + j < last[keep], padded[keep + j], 0)
        rows = table.reshape(-1).view(f"S{4 * self.depth}") if len(keep) else np.empty(0, dtype=f"S{4 * self.depth}")
        order = np.argsort(rows, kind="stable")
        self.keys, self.position = rows[order], keep[order]

    def search(self, windows: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """For each window the range of suffixes that begin with it."""
        width = 4 * self.depth
        low = np.array([np.array(w, dtype=">u4").tobytes() for w in windows], dtype=f"S{width}")
        high = np.array([np.array(w, dtype=">u4").tobytes().ljust(width, b"\xff") for w in windows], dtype=f"S{width}")
        return np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")


def find(block: Block, data: bytes, sizes: list[int]) -> tuple[np.ndarray, list[list[tuple]]]:
    """Words of each text, and its matches: (item, word in item, word in text, words)."""
    text = WordText(data, sizes)
    n_words = np.diff(text.first)
    matches: list[list[tuple]] = [[] for _ in sizes]
    if not block.windows or not len(text.hash):
        return n_words, matches
    array = SuffixArray(block.numbers(text.hash), text.first, block)
    low, high = array.search(block.windows)
    runs: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    for w in np.flatnonzero(high > low):
        window, length = block.windows[w], int(block.length[w])
        words = [block.words[x - 1] for x in window]
        for at in array.position[low[w] : high[w]].tolist():
            if all(text.word(at + j) == words[j] for j in range(length)):
                doc = int(np.searchsorted(text.first, at, side="right")) - 1
                start = at - int(text.first[doc])
                for item, k in block.places[w]:
                    runs[doc, item, start - k].append((start, length))
    for (doc, item, shift), found in runs.items():
        found.sort()
        begin, end = found[0][0], found[0][0] + found[0][1]
        for start, length in found[1:]:
            if start > end:
                matches[doc].append((item, begin - shift, begin, end - begin))
                begin = start
            end = start + length
        matches[doc].append((item, begin - shift, begin, end - begin))
    return n_words, matches


def hit_words(spans) -> int:
    """Words in the union of (start, length) spans."""
    total, reach = 0, 0
    for start, length in sorted(spans):
        total += max(0, start + length - max(start, reach))
        reach = max(reach, start + length)
    return total


_MARKS = "bd_n_words bigint, bd_n_hit bigint, bd_items array<bigint>, bd_spans array<struct<item_id:bigint,item_word:bigint,doc_word:bigint,n_words:bigint>>"
_SPANS = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))


def _pass(df: DataFrame, items: list, size: int, text_col: str, earlier: bool) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(items)

    def make():
        block = Block(sent.value, size)

        def work(batch):
            data, sizes = text_bytes(batch.column(text_col))
            n_words, matches = find(block, data, sizes)
            spans = [[{"item_id": block.item_ids[i], "item_word": a, "doc_word": b, "n_words": n} for i, a, b, n in sorted(m)] for m in matches]
            if earlier:
                spans = [old + new for old, new in zip(batch.column("bd_spans").to_pylist(), spans)]
            items_hit = [sorted({s["item_id"] for s in row if s["item_id"] is not None}) for row in spans]
            n_hit = [hit_words((s["doc_word"], s["n_words"]) for s in row) for row in spans]
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items_hit, pa.list_(pa.int64())), pa.array(spans, _SPANS)]

        return work

    if not earlier:
        return add_columns(df, _MARKS, text_col, make)
    fresh = add_columns(df, _MARKS.replace("bd_", "bdnew_"), text_col, make)
    names = ["bd_n_words", "bd_n_hit", "bd_items", "bd_spans"]
    return fresh.drop(*names).withColumnsRenamed({n.replace("bd_", "bdnew_"): n for n in names})


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """The documents with words, hit words, items and spans (``bd_`` columns)."""
    items = benchmark.select(
        F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = docs
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        out = _pass(out, [tuple(r) for r in own.collect()], size, text_col, k > 0)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns."""
    aside = {c: f"aside_{uuid.uuid4().hex}" for c in docs.columns if c.startswith("bd")}
    marked = mark(docs.withColumnsRenamed(aside), benchmark, **options).where(F.col("bd_n_hit") == 0)
    return marked.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
