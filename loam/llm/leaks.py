"""Evaluation passages inside documents, by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.words import words_text

#: Words of a search pattern, which is also the least run of words that counts, and of the block that decides the shift.
PATTERN, BLOCK = 3, 2
#: Room for words that were put in: one place is a run of this many times the item's words, and ``EDGE`` more.
SLACK, EDGE = 1.25, 4
#: Test items whose patterns a task holds at once; more are searched for in several passes over the documents.
MAX_ITEMS = 20_000


class Patterns:
    """Shift table, suffix buckets and words of the test items. The items are a stated set, held by every task."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = dict(items)
        self.short = {key: tuple(words) for key, words in items if len(words) < PATTERN}
        self.keys = [key for key, words in items if len(words) >= PATTERN]
        self.sizes = np.array([len(self.items[key]) for key in self.keys], int)
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(int)
        places: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for nth, key in enumerate(self.keys):
            words = self.items[key]
            for at in range(len(words) - PATTERN + 1):
                places[tuple(words[at:at + PATTERN])].append((nth, at))
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], dict[tuple[str, ...], int]] = defaultdict(dict)
        self.at: list[dict[int, list[int]]] = []
        self.covers: list[np.ndarray] = []
        for pattern, found in places.items():
            for end in range(BLOCK, PATTERN + 1):
                block = pattern[end - BLOCK:end]
                self.shift[block] = min(self.shift.get(block, PATTERN), PATTERN - end)
            self.bucket[pattern[-BLOCK:]][pattern[:-BLOCK]] = len(self.at)
            where: dict[int, list[int]] = defaultdict(list)
            for nth, at in found:
                where[nth].append(at)
            self.at.append(dict(where))
            self.covers.append(np.array([self.starts[nth] + at + k for nth, at in found for k in range(PATTERN)], int))

    def occurrences(self, words: list[str]) -> list[tuple[int, int]]:
        """(place in the document, pattern) of all patterns that occur, in order."""
        found: list[tuple[int, int]] = []
        jump, head, end, n = PATTERN - BLOCK + 1, PATTERN - BLOCK, PATTERN, len(words)
        shift, bucket = self.shift, self.bucket
        while end <= n:
            block = (words[end - 2], words[end - 1])
            step = shift.get(block, jump)
            if step == 0:
                if (k := bucket[block].get(tuple(words[end - PATTERN:end - PATTERN + head]))) is not None:
                    found.append((end - PATTERN, k))
                step = 1
            end += step
        return found

    def common(self, key: int, words: list[str]) -> int:
        """Length of the longest common subsequence of the item and ``words``, by bits."""
        item = self.items[key]
        mask: dict[str, int] = defaultdict(int)
        for i, w in enumerate(item):
            mask[w] |= 1 << i
        v = full = (1 << len(item)) - 1
        for w in words:
            if m := mask.get(w):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(item) - v.bit_count()

    def leaked(self, words: list[str], share: float) -> Iterator[tuple[int, float]]:
        """Items of which at least ``share`` stands in one place, in order and in runs, with the share of words that the place has in common."""
        hits = self.occurrences(words)
        if hits:
            covered = np.zeros(self.starts[-1], bool)
            covered[np.concatenate([self.covers[k] for _, k in hits])] = True
            enough = np.add.reduceat(covered, self.starts[:-1], dtype=int) >= self.sizes * share  # more than runs cover at all no place has
            for nth in np.flatnonzero(enough):
                key, n = self.keys[nth], int(self.sizes[nth])
                best, begin, end = self.dense([(place, at) for place, k in hits for at in self.at[k].get(int(nth), ())], int(n * SLACK) + EDGE)
                if best >= share * n:
                    yield key, max(best, self.common(key, words[begin:end])) / n
        for key, item in self.short.items():
            k = len(item)
            if k and any(tuple(words[i:i + k]) == item for i in range(len(words) - k + 1)):
                yield key, 1.0

    @staticmethod
    def dense(hits: list[tuple[int, int]], room: int) -> tuple[int, int, int]:
        """Most words of an item, in order, in runs of ``PATTERN`` or more, within ``room`` words of a document, and that place.

        ``hits`` are the places of the item's patterns in the document and in the item; neighbours on one diagonal make a run.
        """
        length: dict[tuple[int, int], int] = {}
        for place, at in sorted(hits):  # a run by its last hit
            length[place, at] = length.pop((place - 1, at - 1), PATTERN - 1) + 1
        runs = sorted((place + PATTERN - n, at + PATTERN - n, n) for (place, at), n in length.items())
        best = (0, 0, 0)
        for s, (first, _, _) in enumerate(runs):
            top: list[tuple[int, int, int]] = []
            for place, at, n in runs[s:]:
                n = min(n, first + room - place)
                if n < PATTERN:  # nor has any later one room left
                    break
                most = n if place == first else 0
                for d_end, i_end, value in top:
                    skip = max(0, d_end - place, i_end - at)  # words that the run before has already
                    if n - skip >= PATTERN:
                        most = max(most, value + n - skip)
                if most:
                    top.append((place + n, at + n, most))
                    best = max(best, (most, first, place + n))
        return best


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least ``share`` of an item's words, in one place and in order.

    Both sides are compared as words, without case, punctuation or layout. Words count in runs of ``PATTERN`` that stand together in both
    texts, so that a few words may be changed, missing or put in, while scattered words that any text shares are no leak. So each place
    holds a pattern of the item: a block table skips what no pattern can reach, suffix buckets pick patterns, a comparison confirms them,
    and an item is measured if its patterns cover ``share`` of it. None is missed, one place being ``SLACK`` times the item's words, and
    ``EDGE`` more. The share told is that of the longest common subsequence in the place. Null and blank texts match nothing, a document
    counts once, null ids are left out, items shorter than a pattern must occur whole, and empty tables give an empty result.
    ``items`` is the stated test set; up to ``MAX_ITEMS`` of them are sent to each task at once, in as many passes as that takes.
    """
    listed = items.where("item_id is not null").dropDuplicates(["item_id"]).select("item_id", words_text(F.col("text")).alias("w"))
    passes = max(1, -(-listed.count() // MAX_ITEMS))
    docs = documents.where("doc_id is not null").select("doc_id", words_text(F.col("text")).alias("w")).where("w <> ''")

    def search(some: list[tuple[int, list[str]]]) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = Patterns(shared.value)
            for b in batches:
                out = [(d, k, s) for d, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, s in patterns.leaked(w.split(), share)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "share"])

        return docs.mapInArrow(run, "doc_id bigint, item_id bigint, share double")

    found = None
    for k in range(passes):
        block = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()
        part = search([(r.item_id, r.w.split()) for r in block])
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item: the documents that hold it, and the largest share held."""
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))
    return items.select("item_id", "suite").join(per, "item_id")
