"""What several operators need: batches of texts, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.session import materialize

# Fixed value: what separates words, as a class of the JVM's and of RE2's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"

# Bytes of text that one numpy step works on; its temporary arrays take about forty times as much.
CHUNK_BYTES = 2 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and whole text as UTF-8 bytes; a NULL text is empty. Other columns are left behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"),
    )


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.lower().split()


def map_texts(
    docs: DataFrame,
    step: Callable[[list, list[bytes]], pa.RecordBatch | None],
    schema: str,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Run ``step(ids, texts)`` over chunks of the rows of ``texts()``, each a few MB or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for start, stop in cuts(sizes, chunk_bytes):
                out = step(ids[start:stop], batch.column(1).slice(start, stop - start).to_pylist())
                if out is not None and out.num_rows:
                    yield out

    return docs.mapInArrow(run, schema)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``most``; a larger item is a range of its own."""
    if len(sizes) == 0:
        return
    part = np.cumsum(sizes + 1) // (most + 1)
    edges = np.flatnonzero(np.diff(part)) + 1
    yield from zip(np.concatenate(([0], edges)).tolist(), np.concatenate((edges, [len(sizes)])).tolist())


def merge_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union the items of each pair. ``labels[i]`` points to a smaller or the same item; roots are smallest items."""
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = labels[labels]
            if np.array_equal(shorter, labels):
                break
            labels = shorter


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from each node of ``links(a, b)``: rows (node, component).

    Alternates the two star steps: every node hands its larger, then its smaller neighbours to its smallest one. The
    rounds grow with the logarithm of a component's diameter. Minima are combined before the shuffle, each round is
    written to the shared folder, and only counts reach the driver.
    """
    edges = materialize(_oriented(links.select("a", "b")), name)
    known = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _oriented(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(_oriented(small), name)
        now = _fingerprint(edges)
        if now == known:
            break
        known = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _oriented(links: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return (
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    sums = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), sums).head())


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), then)[0]
