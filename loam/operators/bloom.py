"""Partition-merged Bloom filters of hashes seen once and repeatedly, one for each range of hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loam.session import fresh_path, materialize

#: A filter's bits are kept in pieces of 2**16, so that a bit within its piece fits two bytes.
PIECE_BITS = 16
BITS_PER_HASH, PROBES = 16, 3
#: Hashes that one filter discriminates; it then has 2**28 bits (32 MB), which bounds what is broadcast. More hashes are parted into ranges with a filter each.
CAPACITY = 1 << 24


def filter_bits(n: int) -> int:
    """Exponent of the filter's size for ``n`` hashes."""
    return int(max(PIECE_BITS, np.ceil(np.log2(max(1, n) * BITS_PER_HASH))))


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, one row a hash, by double hashing."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return ((h[:, None] * np.uint64(0x9E3779B97F4A7C15) + step[:, None] * i * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64)


def _pack(positions: np.ndarray) -> bytes:
    """Sorted two-byte positions, or the piece's whole bitmap where that is shorter."""
    if len(positions) < 1 << (PIECE_BITS - 4):
        return positions.astype("<u2").tobytes()
    bitmap = np.zeros(1 << PIECE_BITS, bool)
    bitmap[positions] = True
    return np.packbits(bitmap).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    bitmap = np.zeros(1 << PIECE_BITS, bool)
    if len(data) == 1 << (PIECE_BITS - 3):
        return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    bitmap[np.frombuffer(data, "<u2")] = True
    return bitmap


def repeated_filter(hashes: DataFrame, bits: int, fan_in: int = 32, least: int = 2) -> bytes:
    """Bitmap of a Bloom filter that holds every hash occurring at least ``least`` (1 or 2) times in column ``h``.

    Each partition keeps the bits of its hashes, and those of hashes it has twice; a task holds no more than its own
    hashes and their bits. Two partitions merge by "again = again of either, or once in both", which keeps every hash
    that two partitions have. Pieces merge in two rounds; what comes back is 2**bits bits, whatever the number of rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
        low = (1 << PIECE_BITS) - 1
        o, a = np.unique(probes(h, bits)), np.unique(probes(h[n > 1], bits))
        pieces = np.unique(o >> PIECE_BITS)
        cut = lambda x: [_pack(x[i:j] & low) for i, j in zip(np.searchsorted(x, pieces << PIECE_BITS), np.searchsorted(x, (pieces + 1) << PIECE_BITS))]
        yield pa.RecordBatch.from_arrays([pa.array(pieces.astype(np.int32)), pa.array(cut(o), pa.binary()), pa.array(cut(a), pa.binary())], ["piece", "once", "again"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, again = np.zeros(1 << PIECE_BITS, bool), np.zeros(1 << PIECE_BITS, bool)
        for o, a in zip(pdf["once"], pdf["again"]):
            o = _unpack(o)
            again |= _unpack(a) | (once & o)
            once |= o
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "once": [_pack(np.flatnonzero(once))], "again": [_pack(np.flatnonzero(again))]})

    shape = "piece int, once binary, again binary"
    parts = hashes.select("h").mapInArrow(scan, shape).withColumn("fan", F.spark_partition_id() % fan_in)
    parts = parts.groupBy("piece", "fan").applyInPandas(merge, shape).groupBy("piece").applyInPandas(merge, shape)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.select("piece", F.col("again" if least > 1 else "once").alias("held")).toLocalIterator():
        k = 1 << (PIECE_BITS - 3)
        out[row.piece * k:(row.piece + 1) * k] = np.packbits(_unpack(bytes(row.held)))
    return out.tobytes()


def _held(h: np.ndarray, bits: int, bitmap: bytes) -> np.ndarray:
    seen, at = np.frombuffer(bitmap, np.uint8), probes(h, bits)
    return ((seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def semi_join(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``id`` is in ``ids`` (one column, id).

    A Bloom filter goes first, so that few other rows are shuffled; with more ids than one filter holds, all rows are.
    """
    hashes = ids.select(F.xxhash64("id").alias("h"))
    n = hashes.count()
    if n > CAPACITY:
        return rows.join(ids, "id", "left_semi")
    bits = filter_bits(n)
    shared = rows.sparkSession.sparkContext.broadcast(repeated_filter(hashes, bits, least=1))
    held = F.pandas_udf(lambda h: pd.Series(_held(h.to_numpy(), bits, shared.value)), BooleanType())
    return rows.where(held(F.xxhash64("id"))).join(ids, "id", "left_semi")


def _tested(rows: DataFrame, bits: int, shared: Broadcast) -> DataFrame:

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = _held(b.column("h").to_numpy(zero_copy_only=False), bits, shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, "repeat"])

    return rows.mapInArrow(test, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", repeat boolean")


def possible_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table with a column ``h``) with a column ``repeat``: false only where ``h`` certainly occurs once.

    Up to ``CAPACITY`` rows share one filter. More are written once more, parted into ranges of hashes of about that
    size, and tested range by range, so that filter, broadcast and driver hold one range at a time, however many rows there are.
    """
    sc, n = rows.sparkSession.sparkContext, rows.count()
    ranges = math.ceil(n / CAPACITY)
    if ranges <= 1:
        bits = filter_bits(n)
        return _tested(rows, bits, sc.broadcast(repeated_filter(rows, bits)))
    bits = filter_bits(math.ceil(n / ranges))
    path = fresh_path(rows.sparkSession, "ranges")
    rows.withColumn("_range", F.pmod(F.hash("h"), F.lit(ranges))).write.partitionBy("_range").parquet(path)
    out = None
    for r in range(ranges):
        part = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/_range={r}")
        shared = sc.broadcast(repeated_filter(part, bits))
        done = materialize(_tested(part, bits, shared), "tested")
        shared.destroy()
        out = done if out is None else out.unionByName(done)
    return out
