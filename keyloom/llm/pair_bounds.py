"""Ranked lexical search with exact scores: MaxScore whose bounds come from term pairs.

Documents are indexed in shards of neighbouring rows. A shard's lists hold the documents of each term with the impacts
that the score adds up, and, for pairs of terms that a query holds side by side in the order of their weights, the largest
impact that the two reach together in one document. A pair adds at most the largest of its own two maxima and the joint
one, which is less than the sum of the maxima where the terms do not meet at their best. Documents that only hold units
(pairs, or a single term) whose bounds stay below the tenth best score known are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.common import cuts, texts
from keyloom.session import materialize

SHARD_BYTES = 8 << 20  # text of a shard; one longer text is a shard of its own
COUNT_BYTES = 1 << 20  # text whose terms are counted in one step
BLOCK_BYTES = 8 << 20  # terms of the queries that are answered together

_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


@dataclass(frozen=True)
class Block:
    """Queries that are answered together: their terms by number, and the numbers that each query holds."""

    numbers: dict[bytes, int]
    queries: list[tuple[int | None, list[int]]]


@dataclass(frozen=True)
class Units:
    """A query's terms side by side in the order of their weights: the pairs by number, and both terms (-1: none)."""

    pair: np.ndarray
    left: np.ndarray
    right: np.ndarray


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other letters and signs beyond ASCII; A-Z lower-cased."""
    return text.translate(_TABLE).split()


def query_terms(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(id, term) of every query, each term once; rows that share an id are one query. NULL texts have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(set(terms_of(data)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], ["id", "term"]
                )

    return texts(items, id_col).mapInArrow(run, "id long, term binary").distinct()


def blocks(terms: DataFrame) -> Iterator[Block]:
    """The queries in blocks of about ``BLOCK_BYTES`` of terms, by the hash of their ids: what the driver holds is bounded."""
    total = terms.agg(F.sum(F.octet_length("term") + 16)).head()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        held: dict[int | None, list[bytes]] = {}
        for r in own.toLocalIterator():
            held.setdefault(r["id"], []).append(bytes(r["term"]))
        names = sorted({t for found in held.values() for t in found})
        numbers = {t: i for i, t in enumerate(names)}
        if held:
            yield Block(numbers, [(item, sorted(numbers[t] for t in found)) for item, found in held.items()])


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """One row per shard: its documents' ids and lengths, and for each of the terms the documents that hold it, how often.

    Columns: ids, n (lengths in terms), terms (numbers, ascending), df (documents of each), docs (places in the shard, term
    after term, ascending), tf.
    """
    width = len(numbers)

    def counts(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths; (place * width + number) of what is found, ascending; how often."""
        get, lengths, found = numbers.get, [], []
        for text in data:
            words = terms_of(text)
            lengths.append(len(words))
            found.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
        n = np.array(lengths, np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        keys = np.repeat(np.arange(len(n)), n) * width + flat
        keys, tf = np.unique(keys[flat >= 0], return_counts=True)
        return n, keys, tf

    def shard(ids: list, data: list[bytes]) -> pa.RecordBatch:
        lengths, places, terms, often, first = [], [], [], [], 0
        for start, stop in cuts(np.array([len(x) for x in data]), COUNT_BYTES):
            n, keys, tf = counts(data[start:stop])
            lengths.append(n)
            places.append(keys // width + first)
            terms.append(keys % width)
            often.append(tf)
            first += stop - start
        n, place, term, tf = (np.concatenate(x) for x in (lengths, places, terms, often))
        order = np.argsort(term, kind="stable")
        present, df = np.unique(term, return_counts=True)
        columns = [
            pa.array([ids], pa.list_(pa.int64())), pa.array([n.astype("<i8").tobytes()]),
            pa.array([present.astype(np.int32).tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())),
            pa.array([place[order].astype("<i4").tobytes()]), pa.array([tf[order].astype("<i4").tobytes()]),
            pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["ids", "n", "terms", "df", "docs", "tf", "n_docs", "n_terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for start, stop in cuts(sizes, SHARD_BYTES):
                yield shard(ids[start:stop], batch.column(1).slice(start, stop - start).to_pylist())

    schema = "ids array<long>, n binary, terms array<int>, df array<long>, docs binary, tf binary, n_docs long, n_terms long"
    return texts(docs).mapInArrow(run, schema)


def weights(shards: DataFrame, width: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, number of documents with a term, and of all their terms: one number per term to the driver."""
    sums = shards.agg(F.sum("n_docs"), F.sum("n_terms")).head()
    n_docs, n_terms = sums[0] or 0, sums[1] or 0
    df = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
    out = np.zeros(width, np.int64)
    for r in df.toLocalIterator():
        out[r["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return out, n_docs, n_terms


def paired(block: Block, weight: np.ndarray) -> tuple[list[Units], np.ndarray]:
    """Units of every query, and the terms (a, b) of every pair."""
    numbers: dict[tuple[int, int], int] = {}
    out = []
    for _, held in block.queries:
        order = sorted(held, key=lambda t: (weight[t], t))
        left = order[0::2]
        right = order[1::2] + [-1] * (len(order) % 2)
        pair = [numbers.setdefault((a, b), len(numbers)) if b >= 0 else -1 for a, b in zip(left, right)]
        out.append(Units(np.array(pair, np.int64), np.array(left, np.int64), np.array(right, np.int64)))
    return out, np.array(list(numbers), np.int64).reshape(-1, 2)


def indexed(shards: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int, pairs: np.ndarray) -> DataFrame:
    """Shards with impacts in place of counts, and for every pair that meets in one the joint maximum impact."""

    def impacts(row: dict) -> pa.RecordBatch:
        n = np.frombuffer(row["n"], "<i8")
        docs, tf = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tf"], "<i4").astype(np.int64)
        terms, df = np.array(row["terms"], np.int64), np.array(row["df"], np.int64)
        m = 10 + (90 * n * n_docs) // max(1, n_terms)
        impact = np.repeat(weight[terms], df) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        ends = np.concatenate(([0], np.cumsum(df)))
        at = np.full(len(weight), -1)
        at[terms] = np.arange(len(terms))
        here = np.flatnonzero((at[pairs[:, 0]] >= 0) & (at[pairs[:, 1]] >= 0)) if len(pairs) else np.zeros(0, np.int64)
        joint, dense, last = np.zeros(len(here), np.int64), np.full(len(n), -1, np.int64), -1
        # Pairs of one first term follow each other, so its impacts are laid out once.
        for i in np.argsort(pairs[here, 0], kind="stable").tolist():
            a, b = at[pairs[here[i]]]
            if a != last:
                if last >= 0:
                    dense[docs[ends[last] : ends[last + 1]]] = -1
                dense[docs[ends[a] : ends[a + 1]]] = impact[ends[a] : ends[a + 1]]
                last = a
            of_a = dense[docs[ends[b] : ends[b + 1]]]
            both = of_a >= 0
            if both.any():
                joint[i] = int((of_a[both] + impact[ends[b] : ends[b + 1]][both]).max())
        met = joint > 0
        columns = [
            pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([row["terms"]], pa.list_(pa.int32())),
            pa.array([ends.astype("<i8").tobytes()]), pa.array([docs.tobytes()]), pa.array([impact.astype("<i8").tobytes()]),
            pa.array([here[met].astype("<i8").tobytes()]), pa.array([joint[met].astype("<i8").tobytes()]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["ids", "terms", "ends", "docs", "impacts", "pairs", "joint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield impacts(batch.slice(i, 1).to_pylist()[0])

    kept = shards.select("ids", "n", "terms", "df", "docs", "tf").where("n_docs > 0")
    return kept.mapInArrow(run, "ids array<long>, terms array<int>, ends binary, docs binary, impacts binary, pairs binary, joint binary")


class Shard:
    """Lists and bounds of one shard, by number of term and of pair."""

    def __init__(self, row: dict, n_terms: int, n_pairs: int):
        self.ids = row["ids"]
        self.order = np.array([(1 << 63) - 1 if i is None else i for i in self.ids], np.int64)
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.docs = np.frombuffer(row["docs"], "<i4")
        self.impacts = np.frombuffer(row["impacts"], "<i8")
        terms = np.array(row["terms"], np.int64)
        self.at = np.full(n_terms + 1, -1)  # the last place is that of no term (-1)
        self.at[terms] = np.arange(len(terms))
        self.most = np.zeros(n_terms + 1, np.int64)
        if len(terms):
            self.most[terms] = np.maximum.reduceat(self.impacts, self.ends[:-1])
        self.joint = np.zeros(n_pairs + 1, np.int64)
        self.joint[np.frombuffer(row["pairs"], "<i8")] = np.frombuffer(row["joint"], "<i8")

    def bounds(self, units: Units) -> np.ndarray:
        """The most that each unit adds to a document of the shard."""
        return np.maximum(np.maximum(self.most[units.left], self.most[units.right]), self.joint[units.pair])

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.at[term]
        if i < 0:
            return self.docs[:0], self.impacts[:0]
        return self.docs[self.ends[i] : self.ends[i + 1]], self.impacts[self.ends[i] : self.ends[i + 1]]

    def best(self, units: Units, k: int, least: int, seeds: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the ``k`` best documents with at least ``least``, and how many were scored.

        ``seeds``: only the documents of the units with the highest bounds, as many units as ``k`` documents take; their
        scores are exact and give a threshold.
        """
        bound = self.bounds(units)
        order = np.argsort(bound, kind="stable")  # weakest first
        below = np.concatenate(([0], np.cumsum(bound[order])))  # the most that the first i units add together
        nothing = np.zeros(0, np.int64)
        if below[-1] == 0 or below[-1] < least:
            return nothing, nothing, 0
        essential = int(np.searchsorted(below[1:], max(1, least), side="left"))  # units before it stay below the threshold
        score = np.zeros(len(self.ids), np.int64)
        at = len(order)
        while at > (0 if seeds else essential):
            at -= 1
            for term in (units.left[order[at]], units.right[order[at]]):
                docs, impacts = self.list_of(term)
                score[docs] += impacts
            if seeds and np.count_nonzero(score) >= k:
                break
        found = np.flatnonzero(score)
        total = score[found]
        scored = len(found)
        for i in range(at - 1, -1, -1):
            able = total + below[i + 1] >= max(1, least)
            if not able.all():
                found, total = found[able], total[able]
            if not len(found):
                break
            for term in (units.left[order[i]], units.right[order[i]]):
                docs, impacts = self.list_of(term)
                if len(docs):
                    place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    total = total + np.where(docs[place] == found, impacts[place], 0)
        good = total >= max(1, least)
        found, total = found[good], total[good]
        top = np.lexsort((self.order[found], -total))[:k]
        return found[top], total[top], scored


def best_of(index: DataFrame, block: Block, units: list[Units], n_pairs: int, k: int, least: dict, seeds: bool = False) -> DataFrame:
    """(item, doc_id, score): for every task the ``k`` best of its shards for every query, at least ``least`` of each.

    The k-th best of a task's earlier shards is the threshold for its later ones, if it is higher.
    """
    queries, n_terms = block.queries, len(block.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in queries]
        floor = [least.get(item, 0) for item, _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(batch.slice(r, 1).to_pylist()[0], n_terms, n_pairs)
                for q, own in enumerate(units):
                    found, total, _ = shard.best(own, k, floor[q], seeds)
                    if not len(found):
                        continue
                    more = [(-s, shard.order[p].item(), shard.ids[p]) for p, s in zip(found.tolist(), total.tolist())]
                    held[q] = sorted(held[q] + more, key=lambda x: x[:2])[:k]
                    if len(held[q]) == k:
                        floor[q] = max(floor[q], -held[q][-1][0])
        rows = [(item, doc_id, -s) for (item, _), found in zip(queries, held) for s, _, doc_id in found]
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id") -> DataFrame:
    """The ``k`` best of all ``docs(doc_id, text)`` for every row of ``items(item_id, text)``: (item_id, rank, doc_id, score).

    Scores are exact integers; only documents with a score above 0 are given. Equal scores are ranked by doc_id, NULL
    last; rows of ``docs`` that repeat a doc_id are documents of their own, and rows of ``items`` that repeat an id are one
    query. NULL and empty texts hold no terms; queries without terms, and empty tables, give no rows.
    """
    terms = materialize(query_terms(items, id_col), "query-terms")
    out = None
    for block in blocks(terms):
        shards = materialize(counted(docs, block.numbers), "term-counts")
        weight, n_docs, n_terms = weights(shards, len(block.numbers))
        units, pairs = paired(block, weight)
        index = materialize(indexed(shards, weight, n_docs, n_terms, pairs), "impact-index")
        seeds = best_of(index, block, units, len(pairs), k, {}, seeds=True)
        ordered = F.reverse(F.sort_array(F.collect_list("score")))
        least = {
            r["item"]: r["kth"] for r in seeds.groupBy("item").agg(F.get(ordered, F.lit(k - 1)).alias("kth")).toLocalIterator() if r["kth"]
        }
        found = best_of(index, block, units, len(pairs), k, least)
        own = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        ranked = ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(materialize(ranked, "ranked"))
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
