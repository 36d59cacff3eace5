"""Cutting oversized texts at content-defined places that snap to natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.text import estimate_tokens

#: Characters of the rolling hash's window, and the share 1/2**LANDMARK_BITS of positions that are landmarks.
WINDOW, LANDMARK_BITS = 24, 5
BASE = np.uint64(0x5851F42D4C957F2D)
CHARS_PER_TOKEN = 4
#: Natural boundaries, best first: after a paragraph, after a line or table row, after a sentence, after a word.
BOUNDARIES = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n[^\S\n]*"), re.compile(r"[.!?…][\"'»”’)\]]*\s+"), re.compile(r"\s+"))


def landmark_hashes(text: str) -> np.ndarray:
    """For each position p, a hash of the WINDOW characters before it (of fewer near the start)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros(len(codes) + 1, np.uint64)
        power = np.uint64(1)
        for k in range(min(WINDOW, len(codes))):
            out[k + 1:] += codes[: len(codes) - k] * power
            power *= BASE
        out ^= out >> np.uint64(29)
        return (out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)


def _splits_character(text: str, p: int) -> bool:
    """Whether a cut at p would part a base letter from its marks, a joined emoji or a CR from its LF."""
    if not 0 < p < len(text):
        return False
    return unicodedata.combining(text[p]) > 0 or text[p] in "‍️" or text[p - 1] == "‍" or text[p - 1:p + 1] == "\r\n"


def cut_points(text: str, max_chars: int, min_chars: int, overlap: int) -> list[int]:
    """Ends of all pieces. The first body may have ``max_chars`` characters, later ones so many less the overlap.

    A landmark is a place whose preceding window's hash is the least of those that fall on it by content alone, so an
    edit moves only the cuts around it. Among the places a body may end, the best kind of boundary is taken, and of
    that kind the one nearest to the landmark that is strongest in reach.
    """
    found = [np.array([m.end() for m in b.finditer(text)], np.int64) for b in BOUNDARIES]
    hashes = landmark_hashes(text)
    marks = np.flatnonzero((hashes & np.uint64((1 << LANDMARK_BITS) - 1)) == 0)
    cuts, start, n = [], 0, len(text)
    while n - start > (room := max_chars - (overlap if cuts else 0)):
        low, high = start + min(min_chars, room // 2), start + room
        near = marks[(marks >= low) & (marks <= high)]
        mark = int(near[np.argmin(hashes[near])]) if len(near) else high
        end = 0
        for places in found:
            ok = places[(places >= low) & (places <= high) & (places < n)]
            if len(ok):
                end = int(ok[np.argmin(np.abs(ok - mark))])
                break
        if not end:
            end = mark
            while end > low and _splits_character(text, end):
                end -= 1
        cuts.append(end)
        start = end
    return [*cuts, n]


def pieces_of(text: str, max_tokens: int, min_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each piece, in characters; start includes the overlap with the piece before."""
    size, overlap = max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    out, last = [], 0
    for end in cut_points(text, size, max(min_tokens * CHARS_PER_TOKEN, overlap), overlap):
        back = min(overlap, last)
        out.append((last - back, end, back))
        last = end
    return out


def split_oversized(texts: DataFrame, limits: DataFrame, kind: str) -> DataFrame:
    """(record_kind, chunk_id, piece_no, piece_count, overlap_chars, text) for each text over its limit.

    ``texts`` has chunk_id and text; ``limits`` is the configuration, one row with max_tokens, min_tokens and
    overlap_tokens (several rows or none are an error). A text is over the limit if its estimate, ceil(characters / 4)
    and 0 for a blank one, exceeds max_tokens; all others, nulls among them, give no row. Rows that repeat a chunk_id
    count once, null ids are left out, and an empty table gives an empty result. Text without any boundary is cut at a landmark
    or, for lack of one, at the limit. Pieces without their overlaps, joined, are the text again.
    """
    conf = limits.collect()  # one row by definition
    if len(conf) != 1:
        raise ValueError("the chunk configuration must have exactly one row")
    most, least, overlap = (int(conf[0][c]) for c in ("max_tokens", "min_tokens", "overlap_tokens"))
    if not 0 <= overlap < most // 2 or not 0 < least <= most:
        raise ValueError("chunk limits must satisfy 0 <= overlap < max / 2 and 0 < min <= max")
    large = texts.select("chunk_id", "text").where((estimate_tokens(F.col("text")) > most) & F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("chunk_id").to_pylist(), b.column("text").to_pylist()):
                cut = pieces_of(text, most, least, overlap)
                yield pa.RecordBatch.from_pydict({
                    "chunk_id": [key] * len(cut), "piece_no": list(range(len(cut))), "piece_count": [len(cut)] * len(cut),
                    "overlap_chars": [o for _, _, o in cut], "text": [text[s:e] for s, e, _ in cut],
                }, schema=shape)

    kind_of = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[dict(large.dtypes)["chunk_id"]]
    shape = pa.schema([("chunk_id", kind_of), ("piece_no", pa.int32()), ("piece_count", pa.int32()), ("overlap_chars", pa.int32()), ("text", pa.string())])
    out = large.mapInArrow(run, f"chunk_id {dict(large.dtypes)['chunk_id']}, piece_no int, piece_count int, overlap_chars int, text string")
    return out.select(F.lit(kind).alias("record_kind"), "*")


def limits_of(config: DataFrame, prefix: str) -> DataFrame:
    """The limits of ``parent`` or ``child`` chunks from the project's configuration row."""
    return config.select(*[F.col(f"{prefix}_{c}").alias(c) for c in ("max_tokens", "min_tokens")], "overlap_tokens")
