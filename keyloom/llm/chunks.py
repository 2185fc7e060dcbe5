"""Texts in written chunks, and which of their keys occur in more than one text anywhere.

A chunk is a row with some MB of whole texts. Keys travel as packed arrays per chunk and bucket, so that shuffles move
few rows; a bucket's task sees each key at most twice per chunk, however often a text or passage is repeated.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import map_texts, texts
from keyloom.session import work_dir

NO_ID = np.iinfo(np.int64).max  # stands for a NULL id, which is larger than all others
LEVEL = 5  # of compression: chunks are written once and shuffled twice
BUCKET_KEYS = 3 << 20  # keys that one task compares


@dataclass
class Chunk:
    ids: np.ndarray
    offsets: np.ndarray  # of the texts in data, with the end
    data: bytes


def written(docs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Rows (chunk, ids, sizes, data) of all texts of ``docs(doc_id, text)``, and their bytes in total.

    They are written once in buckets of ``chunk``, so that joins on it, of which several follow, do not shuffle texts.
    """

    def step(ids, data):
        numbers = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        sizes = np.array([len(t) for t in data], dtype=np.int64)
        columns = [pa.array([c], pa.binary()) for c in (numbers.tobytes(), sizes.tobytes(), packed(b"".join(data)))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([int(sizes.sum())])], ["ids", "sizes", "data", "bytes"])

    rows = map_texts(texts(docs), step, "ids binary, sizes binary, data binary, bytes long")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = rows.withColumn("chunk", F.monotonically_increasing_id()).repartition(n, "chunk")
    dealt.write.bucketBy(n, "chunk").option("path", f"{work_dir(spark)}/{table}").saveAsTable(table)
    rows = spark.table(table)
    return rows, int(rows.agg(F.sum("bytes")).head()[0] or 0)


def opened(ids: bytes, sizes: bytes, data: bytes) -> Chunk:
    lengths = np.frombuffer(sizes, dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return Chunk(np.frombuffer(ids, dtype=np.int64), offsets, unpacked(data, int(offsets[-1])))


def packed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True) if data else b""


def unpacked(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, decompressed_size=size, asbytes=True) if size else b""


def over_chunks(
    rows: DataFrame, step: Callable[..., Iterator[pa.RecordBatch]], schema: str, extra: str | None = None, arrow: bool = False
) -> DataFrame:
    """Run ``step(number, chunk[, extra value])`` for each row of ``written()``, with the list column ``extra`` joined on.

    With ``arrow`` its value is an Arrow scalar (see :func:`listed`).
    """
    names = ["chunk", "ids", "sizes", "data"] + ([extra] if extra else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, sizes, data = (batch.column(c)[i].as_py() for c in range(4))
                yield from step(number, opened(ids, sizes, data), *(batch.column(c)[i] if arrow else batch.column(c)[i].as_py() for c in range(4, len(names))))

    return rows.select(*names).mapInArrow(run, schema)


def buckets_for(keys: float) -> int:
    """Number of buckets for about that many keys."""
    return max(12, math.ceil(keys / BUCKET_KEYS))


def colliding(rows: DataFrame, keys_of: Callable[[Chunk], np.ndarray], buckets: int, often: int | None = None) -> DataFrame:
    """(chunk, keys): for each chunk the lower 32 bits, per bucket, of its keys that occur twice or more.

    ``keys_of`` gives a chunk's 64-bit keys, each once, or twice if texts of the chunk share it. Keys are compared by
    bucket (from the upper half) and lower half, so the result may name a few more than really collide.

    With ``often`` there is a column ``hot``, the keys of ``keys`` that over ``often`` texts have; a chunk then gives a key
    once more for each doubling of its texts that have it, and counts as the least number of texts that would.
    """

    def send(number: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        keys = keys_of(chunk)
        bucket, low = halves(keys, buckets)
        if buckets <= 1 << 16:
            bucket = bucket.astype(np.uint16)  # which are sorted by digits
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        low = low[order]
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            yield pa.RecordBatch.from_arrays([
                pa.array(full.astype(np.int32)), pa.array(np.full(len(full), number, dtype=np.int64)),
                pa.array([low[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
            ], ["bucket", "chunk", "keys"])

    def meet(group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, dtype=np.uint32) for k in group.column("keys").to_pylist()]
        keys = np.concatenate(lists)
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        hits = np.isin(keys, twice, assume_unique=False) if len(twice) else np.zeros(len(keys), dtype=bool)
        edges = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        out = [np.unique(keys[a:b][hits[a:b]]) for a, b in zip(edges, edges[1:])]
        some = [i for i, x in enumerate(out) if len(x)]
        hot = {}
        if often is not None:
            frequent = _frequent(lists, ordered, often)
            hot = {"hot": pa.array([out[i][np.isin(out[i], frequent)].tobytes() for i in some], pa.binary())}
        return pa.table({
            "chunk": group.column("chunk").take(pa.array(some, pa.int64())),
            "bucket": group.column("bucket").take(pa.array(some, pa.int64())),
            "keys": pa.array([out[i].tobytes() for i in some], pa.binary()),
        } | hot)

    sent = over_chunks(rows, send, "bucket int, chunk long, keys binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk long, bucket int, keys binary" + ", hot binary" * (often is not None))


def _frequent(lists: list[np.ndarray], ordered: np.ndarray, often: int) -> np.ndarray:
    """Keys for which ``2**(times - 1)``, summed over the lists that have them, is more than ``often``."""
    apart = often.bit_length()  # fewer others of the same key do not suffice
    some = np.unique(ordered[apart:][ordered[apart:] == ordered[: max(0, len(ordered) - apart)]])
    weights = np.zeros(len(some), dtype=np.int64)
    for keys in lists if len(some) else ():
        values, times = np.unique(keys[np.isin(keys, some)], return_counts=True)
        weights[np.searchsorted(some, values)] += np.left_shift(1, times - 1)
    return some[weights > often]


def halves(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and lower half of each key."""
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), keys.astype(np.uint32)


def listed(found: pa.ListScalar | pa.StructScalar, *columns: str) -> list[np.ndarray]:
    """Columns of numbers of a list that :func:`with_lists` joined on; empty ones for NULL."""
    if not found.is_valid:
        return [np.zeros(0, dtype=np.int64)] * len(columns)
    return [found.values.field(c).to_numpy(zero_copy_only=False) for c in columns]


def places(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``values`` are in ``known``, and where (anywhere, for those that are not)."""
    if not len(known):
        return np.zeros(values.shape, dtype=bool), np.zeros(values.shape, dtype=np.int64)
    order = np.argsort(known)
    ordered = known[order]
    at = np.minimum(np.searchsorted(ordered, values), len(known) - 1)
    return ordered[at] == values, order[at]


def among(keys: np.ndarray, found: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
    """Which of a chunk's keys its list of (bucket, keys) names."""
    if not found or not len(keys):
        return np.zeros(len(keys), dtype=bool)
    bucket, low = halves(keys, buckets)
    named = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, dtype=np.uint32).astype(np.uint64) for b, k in found])
    return places((bucket.astype(np.uint64) << np.uint64(32)) | low, named)[0]


def with_lists(rows: DataFrame, found: DataFrame, columns: list[str], name: str = "found") -> DataFrame:
    """``rows`` with the list ``name`` of each chunk's rows of that table (NULL if it has none)."""
    lists = found.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias(name))
    return rows.join(lists, "chunk", "left")
