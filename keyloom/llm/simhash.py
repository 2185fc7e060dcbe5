"""Near duplicates by SimHash, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import components, map_texts, merge_labels, texts, words_of
from keyloom.llm.jaccard import linked_sets
from keyloom.session import materialize

SEED = 42
TILE = 8192  # fingerprints in a tile
STRIP = 1 << 17  # pairs compared by one numpy step
_LANES = np.uint64(0x0101010101010101)
_HALF = np.uint64(0xFFFFFFFF)
_QUARTER = np.uint64(0xFFFF)
_MIXES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)  # of the further 64 bits of a sketch
RADIUS = 72  # of the bits of a sketch


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """Hashes of the ``width``-word shingles, repeats included; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = list(accumulate(map(len, words)))  # without the spaces
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + i for i, e in enumerate(ends, 1))]
    stops = [e + i for i, e in enumerate(ends[width - 1 :], width - 1)]
    return [digest(line[x:y], SEED) for x, y in zip(starts, stops)]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes, the number whose bits are set in over half of them; 0 for an empty run."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    begins = np.cumsum(sizes) - sizes
    pieces = -(-sizes // 255)  # a byte lane counts to 255
    firsts = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(firsts, pieces)
    starts = np.repeat(begins, pieces) + within * 255
    votes = np.empty((len(full), 8, 8), dtype=bool)  # run, byte, bit of the byte
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), firsts, axis=0, dtype=np.int64)
        votes[:, :, bit] = counts * 2 > sizes[:, None]
    out[full] = np.packbits(votes, axis=2, bitorder="little").reshape(-1, 8).view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; NULL and empty texts have fingerprint 0."""

    def step(ids, data):
        hashes, sizes = [], []
        for text in data:
            found = shingle_hashes(text, width)
            hashes.append(np.array(found, dtype=np.uint64))
            sizes.append(len(found))
        values = majorities(np.concatenate(hashes), np.array(sizes)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values)], ["doc_id", "fp"])

    return map_texts(texts(docs), step, "doc_id long, fp long")


def linked(fps: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct values of ``fps.fp`` that connect all values within ``radius`` bits.

    Values with the same population counts of both 32-bit halves form tiles of about ``tile`` values, split by a
    hash. Two tiles meet only if their counts differ by at most ``radius`` in sum, as every differing bit changes one
    of the counts by one. A tile pair is compared whole by exclusive or and bit count, and hands on a spanning forest
    of its links, so a group of many mutual copies costs no quadratic output.
    """
    spark = fps.sparkSession
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = fps.select("fp").distinct().select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(low).alias("lo")
    )
    halves = materialize(halves, "simhash-values")
    # at most 33 * 33 rows
    counted = halves.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("blocks")).collect()
    cells = spark.createDataFrame([tuple(r) for r in counted], "hi int, lo int, blocks int")
    tiles = (
        halves.join(F.broadcast(cells), ["hi", "lo"])
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .groupBy("hi", "lo", "block")
        .agg(F.sort_array(F.collect_list("fp")).alias("values"))
    )
    tiles = materialize(tiles, "simhash-tiles")
    pairs = _tile_pairs(cells, radius)
    first = tiles.select(*[F.col(c).alias(f"{c}1") for c in ("hi", "lo", "block", "values")])
    second = tiles.select(*[F.col(c).alias(f"{c}2") for c in ("hi", "lo", "block", "values")])
    met = pairs.join(first, ["hi1", "lo1", "block1"]).join(second, ["hi2", "lo2", "block2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                nodes, roots = _forest(a, b, radius)
                if len(nodes):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])

    return met.select("values1", "values2").mapInArrow(compare, "a long, b long")


def _tile_pairs(cells: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles, each once, whose population counts differ by at most ``radius``."""
    steps = [
        (i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius
    ]
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = cells.select("hi", "lo", block.alias("block"))
    first = cells.select(F.col("hi").alias("hi1"), F.col("lo").alias("lo1"), "blocks", moves.alias("move"))
    first = first.where("(move.i, move.j) >= (0, 0)").select(
        "hi1", "lo1", (F.col("hi1") + F.col("move.i")).alias("hi2"), (F.col("lo1") + F.col("move.j")).alias("lo2"),
        block.alias("block1"),
    )
    second = tiles.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("block").alias("block2"))
    own = (F.col("hi1") == F.col("hi2")) & (F.col("lo1") == F.col("lo2"))
    return first.join(second, ["hi2", "lo2"]).where(~own | (F.col("block1") <= F.col("block2")))


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of both tiles with the root that the pairs within ``radius`` give them.

    Inside a tile all values have the same counts, so the count of the lowest quarter decides for rows of one tile
    which rows of the other can be near enough.
    """
    count = np.bitwise_count
    hi, lo = (int(count(b[0] >> k & _HALF)) - int(count(a[0] >> k & _HALF)) for k in (np.uint64(32), np.uint64(0)))
    a, b = (x[np.argsort(count(x & _QUARTER), kind="stable")] for x in (a, b))
    rows, columns = count(a & _QUARTER).astype(np.int64), count(b & _QUARTER).astype(np.int64)
    labels = np.arange(len(a) + len(b))
    for q in np.unique(rows):
        near = np.flatnonzero(np.abs(columns - q) + np.abs(lo - (columns - q)) + abs(hi) <= radius)
        if not len(near):
            continue
        top, end = np.searchsorted(rows, (q, q + 1))
        first, last = near[0], near[-1] + 1
        height = max(1, STRIP // min(STRIP, last - first))
        for i in range(top, end, height):
            for j in range(first, last, STRIP):
                strip = b[j : min(last, j + STRIP)]
                close = count(a[i : min(end, i + height), None] ^ strip) <= radius
                found = np.flatnonzero(close.ravel())
                if len(found):
                    left, right = np.divmod(found, len(strip))
                    labels = merge_labels(labels, left + i, right + (j + len(a)))
    both = np.concatenate((a, b)).view(np.int64)
    moved = np.flatnonzero((labels != np.arange(len(labels))) & (both != both[labels]))
    return both[moved], both[labels[moved]]


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over fingerprints at most ``radius`` bits apart. A NULL or empty
    text has fingerprint zero and is linked like any other; rows that repeat a doc_id stay rows; rows without a doc_id
    keep a component but never name it (NULL if no member has one). An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, width), "simhash")
    groups = components(linked(fps, radius), "simhash-components")
    by_value = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_value = by_value.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    by_value = by_value.withColumn("component", F.coalesce("component", "fp"))
    named = by_value.groupBy("component").agg(F.min("least").alias("component_id"))
    by_value = by_value.join(named, "component").select("fp", "component_id")
    return fps.join(by_value, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _name(shingles: np.ndarray) -> int:
    """A signed number for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, node, h1, h2, h3, h4): see ``_sketches``."""
    return _sketches(docs, width).drop("digest")


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, node, h1, h2, h3, h4): a number for the text's set of shingles, and a SimHash of the set, of 256 bits.

    Each shingle votes once, however often the text has it, as sets are what is compared. ``digest`` is the engine's
    64-bit hash of the text: with it rows that share a doc_id are told apart.
    """
    names = [f"h{i}" for i in range(1, len(_MIXES) + 2)]

    def step(ids, data):
        hashes, sizes, nodes = [], [], []
        for text in data:
            found = np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))
            hashes.append(found)
            sizes.append(len(found))
            nodes.append(_name(found))
        hashes, sizes = np.concatenate(hashes), np.array(sizes)
        columns = [pa.array([i[c] for i in ids], pa.int64()) for c in ("doc_id", "digest")]
        columns += [pa.array(nodes, pa.int64()), pa.array(majorities(hashes, sizes).view(np.int64))]
        for factor in _MIXES:
            other = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(factor)
            other ^= other >> np.uint64(29)
            columns.append(pa.array(majorities(other, sizes).view(np.int64)))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "node", *names])

    rows = texts(docs).select(F.struct("doc_id", F.xxhash64("data").alias("digest")).alias("key"), "data")
    return map_texts(rows, step, "doc_id long, digest long, node long, " + ", ".join(f"{n} long" for n in names))


def near_nodes(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between nodes(node, h1, h2 ...) that connect all within ``radius`` of all bits; see ``linked``.

    Tiles are cut by the population count in steps of ``radius``, so only tiles of the same or the next step meet.
    """
    spark = nodes.sparkSession
    words = [c for c in nodes.columns if c.startswith("h")]
    step = (sum((F.bit_count(c) for c in words), F.lit(0)) / radius).cast("int")
    nodes = nodes.select("node", *words, step.alias("step"))
    # at most 257 / radius rows
    counted = nodes.groupBy("step").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("blocks")).collect()
    cells = spark.createDataFrame([(r["step"], 0, r["blocks"]) for r in counted], "hi int, lo int, blocks int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = nodes.withColumnRenamed("step", "hi").join(F.broadcast(cells.drop("lo")), "hi").withColumn("block", block)
    tiles = materialize(tiles.groupBy("hi", "block").agg(F.collect_list(F.struct("node", *words)).alias("values")), "sketch-tiles")
    first, second = (tiles.select(*[F.col(c).alias(f"{c}{i}") for c in ("hi", "block", "values")]) for i in (1, 2))
    met = _tile_pairs(cells, 1).where("lo1 = lo2").join(first, ["hi1", "block1"]).join(second, ["hi2", "block2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                (an, *a), (bn, *b) = (
                    [v.values.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(len(words) + 1)] for v in (x, y)
                )
                labels = np.arange(len(an) + len(bn))
                height = max(1, STRIP // max(1, len(bn)))
                for i in range(0, len(an), height):
                    apart = np.zeros((len(an[i : i + height]), len(bn)), dtype=np.uint16)
                    for p, q in zip(a, b):
                        apart += np.bitwise_count(p[i : i + height, None] ^ q)
                    found = np.flatnonzero((apart <= radius).ravel())
                    if len(found):
                        left, right = np.divmod(found, len(bn))
                        labels = merge_labels(labels, left + i, right + len(an))
                both = np.concatenate((an, bn)).view(np.int64)
                moved = np.flatnonzero(both != both[labels])
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(both[moved]), pa.array(both[labels[moved]])], ["a", "b"])

    return met.select("values1", "values2").mapInArrow(compare, "a long, b long")


def similar_components(docs: DataFrame, similar: float = 0.8, width: int = 5, radius: int = RADIUS) -> DataFrame:
    """(doc_id, digest, node, component, component_id) for every row of ``docs(doc_id, text)``.

    ``component`` is a number of the group of similar rows, ``component_id`` its smallest doc_id (groups that share one
    are told apart by ``component``); ``digest`` as in ``sketches``. Rows are linked if the sets of their ``width``-word shingles have a Jaccard similarity of ``similar`` or more.
    Candidates are found by 256-bit SimHashes of the sets within ``radius`` bits: at a similarity of 0.8 about 39 bits
    differ (48 in the smallest sets, of 4 and 5 shingles), between unrelated texts 128 with a deviation of 8. The shingles
    of a group of candidates are then compared exactly. Texts without words are equal to each other.
    """
    rows = materialize(_sketches(docs, width), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in rows.columns if c.startswith("h")])
    nodes = materialize(nodes, "sketch-nodes")
    groups = components(near_nodes(nodes, radius), "sketch-groups").withColumnRenamed("component", "key")
    chosen = nodes.where("least IS NOT NULL").join(groups, "node").select(F.col("least").alias("doc_id"), "node", "key")

    def step(keys, data):
        rows = []
        for key, text in zip(keys, data):
            found = np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))
            if _name(found) == key["name"]:  # rows that share a doc_id may have other texts
                rows.append((key["key"], key["name"], (found >> np.uint64(32)).astype("<u4").tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "name", "items"])

    texts_of = texts(docs).join(chosen, "doc_id").select(F.struct("key", F.col("node").alias("name")).alias("key"), "data")
    sets = map_texts(texts_of, step, "key long, name long, items binary").dropDuplicates(["key", "name"])
    found = components(linked_sets(sets, similar), "similar-components")
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "component", "component_id")
    return rows.select("doc_id", "digest", "node").join(named, "node")


def keep_one(docs: DataFrame, similar: float = 0.8, width: int = 5) -> DataFrame:
    """The row with the smallest doc_id of every group of similar documents, with all its columns.

    Of the texts without words one stays. Unrelated texts that share a doc_id are groups of their own and all stay; of
    similar ones that share the smallest doc_id the one whose text has the smallest hash stays, of repeated rows one. Rows
    without a doc_id cannot be named and are all kept.
    """
    found = similar_components(docs.select("doc_id", "text"), similar, width).where("doc_id IS NOT NULL")
    least = found.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("row"))
    kept = least.select(F.col("row.doc_id").alias("_id"), F.col("row.digest").alias("_digest")).distinct()
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    named = docs.where("doc_id IS NOT NULL").withColumn("_id", F.col("doc_id").cast("long")).withColumn("_digest", digest)
    named = named.join(kept, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).drop("_id", "_digest")
    return named.unionByName(docs.where("doc_id IS NULL"))
