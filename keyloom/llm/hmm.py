"""Language model scoring with a hidden Markov model trained by Baum and Welch's method.

The observed symbols are the frequent words, a class for every other word (by its last bytes), and the end of a text.
A latent state emits a symbol; a word of a class then has the class's share of it, which does not depend on the state.
So the latent part has a bounded number of parameters, while every word of the corpus keeps its own probability.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import map_texts, texts, words_of
from keyloom.session import materialize

HEAD = 40_000  # most frequent words with symbols of their own
HEAD_LEAST = 5  # and how often each has to occur
CLASSES = 512  # of the other words
STATES = 6
ROUNDS = 5
BATCH_TOKENS = 1 << 19  # tokens whose recursions run side by side
HELD_OUT = (7, 2)  # crc32 of the id as text, modulo and remainder
END = ""  # the end of a text among the words; no word is empty


def held_out(doc_id: F.Column | str) -> F.Column:
    """Whether a document is kept from training; a NULL id counts as an empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % HELD_OUT[0] == HELD_OUT[1]


def _is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _class_column(word: str) -> F.Column:
    """``word_class`` as an expression on a binary column."""
    return (F.crc32(F.substring(word, -3, 3)) % CLASSES).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word, and the end, occurs in the training rows of ``texts()``."""

    def step(ids, data):
        counts: Counter = Counter()
        for text in data:
            counts.update(words_of(text))
        counts[b""] = len(data)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"]
        )

    found = map_texts(docs.where(~held_out("doc_id")), step, "word binary, c long", chunk_bytes=32 << 20)
    return found.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What tasks need to know about words: bounded by HEAD and CLASSES."""

    symbols: dict[bytes, int]  # frequent words, and the end
    counts: np.ndarray  # of each of these
    tokens: int  # in training
    distinct: int
    class_tokens: np.ndarray  # tokens of each class's words
    class_single: np.ndarray  # words of each class that occur once

    @property
    def size(self) -> int:
        return len(self.symbols) + CLASSES

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))


def lexicon(counts: DataFrame, head: int = HEAD, least: int = HEAD_LEAST) -> Lexicon:
    """The lexicon of ``counts(word, c)``, the written result of ``word_counts``."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).head()
    top = counts.where((F.col("c") >= least) & (F.length("word") > 0)).orderBy(F.desc("c"), "word").limit(head).collect()
    ends = counts.where(F.length("word") == 0).collect()
    symbols = {bytes(r["word"]): i for i, r in enumerate(top)}
    symbols[b""] = len(symbols)
    # words as frequent as the last of the head are told apart by their order
    last = (top[-1]["c"], bytes(top[-1]["word"])) if len(top) == head else None
    rest = counts.where(F.length("word") > 0)
    tail = F.col("c") < least
    if last:
        tail = tail | (F.col("c") < last[0]) | ((F.col("c") == last[0]) & (F.col("word") > F.lit(last[1])))
    classes = rest.where(tail).groupBy(_class_column("word").alias("k")).agg(
        F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("single")
    )
    tokens, single = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes.collect():
        tokens[r["k"]], single[r["k"]] = r["tokens"], r["single"]
    heads = [r["c"] for r in top] + [ends[0]["c"] if ends else 0]
    return Lexicon(symbols, np.array(heads, dtype=float), total["n"] or 0, total["v"], tokens, single)


def encoded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """Rows of ``texts()`` as symbols: row, doc_id, held_out, n_tokens, n_head, base_head, symbols, tail_words, tail_counts.

    ``symbols`` are little-endian 16-bit numbers. Words without a symbol of their own are also listed, each once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base_head", pa.float64()),
        ("symbols", pa.binary()), ("tail_words", pa.list_(pa.binary())), ("tail_counts", pa.list_(pa.int32())),
    ])

    def step(ids, data):
        lex = shared.value
        base, get, first = lex.base(lex.counts), lex.symbols.get, len(lex.symbols)
        rows = []
        for doc_id, text in zip(ids, data):
            split = words_of(text)
            numbers = np.fromiter(map(get, split, (-1,) * len(split)), dtype=np.int64, count=len(split))
            numbers = np.append(numbers, first - 1)
            missing = np.flatnonzero(numbers < 0)
            tail = [split[i] for i in missing.tolist()]
            own = numbers[numbers >= 0]
            numbers[missing] = [first + word_class(w) for w in tail]
            counts = Counter(tail)
            known = int((lex.counts[own] > 0).sum())
            rows.append((
                doc_id, _is_held_out(doc_id), len(numbers), known, float(base[own].sum()), numbers.astype("<u2").tobytes(),
                list(counts), list(counts.values()),
            ))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    out = map_texts(
        docs, step,
        "doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, symbols binary, "
        "tail_words array<binary>, tail_counts array<int>",
    )
    return out.withColumn("row", F.monotonically_increasing_id())


@dataclass
class Parameters:
    initial: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x symbols


def start_parameters(words: Lexicon, states: int) -> Parameters:
    """Sticky states whose emissions are the training shares, each disturbed in its own, reproducible way."""
    share = _shares(words)
    noise = np.random.default_rng(7).uniform(0.5, 1.5, (states, words.size))
    emit = share * noise
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Parameters(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def _shares(words: Lexicon) -> np.ndarray:
    """Share of each symbol in training, every symbol counted once more."""
    counts = np.concatenate((words.counts, words.class_tokens)) + 1
    return counts / counts.sum()


class _Sheaf:
    """Symbol sequences side by side: position by position, longest sequence first."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in sequences], kind="stable")
        sizes = np.array([len(sequences[i]) for i in self.order])
        self.active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # sequences longer than t
        self.starts = np.concatenate(([0], np.cumsum(self.active)))
        flat = np.concatenate([sequences[i] for i in self.order])
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        which = np.repeat(np.arange(len(sizes)), sizes)
        self.symbols = np.empty(len(flat), dtype=np.int64)
        self.symbols[self.starts[at] + which] = flat
        self.sequence = np.empty(len(flat), dtype=np.int64)
        self.sequence[self.starts[at] + which] = which

    def slices(self):
        edges = self.starts.tolist()
        return list(zip(edges, edges[1:]))

    def forward(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward values, scales, and emission probabilities, position by position."""
        emitted = p.emit.T[self.symbols]
        alpha = emitted.copy()
        scales = np.empty(len(alpha))
        parts = self.slices()
        previous = None
        for a, b in parts:
            now = alpha[a:b]
            now *= p.initial if previous is None else previous[: b - a] @ p.move
            total = now.sum(axis=1)
            scales[a:b] = total
            now /= total[:, None]
            previous = now
        return alpha, scales, emitted

    def log10(self, p: Parameters) -> np.ndarray:
        """log10 of each sequence's probability, in the order given."""
        _, scales, _ = self.forward(p)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.sequence, np.log10(scales), len(self.order))
        return out

    def expected(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts: first states, moves, states x symbols; and the log10 probability of all sequences."""
        alpha, scales, emitted = self.forward(p)
        weighted = emitted
        weighted /= scales[:, None]  # emission over scale, then times beta
        gamma = alpha
        parts = self.slices()
        moves = np.zeros_like(p.move)
        back = p.move.T.copy()
        following = None
        for a, b in reversed(parts):
            here = weighted[a:b]
            if following is not None:
                n = len(following)
                moves += alpha[a : a + n].T @ following
                beta = following @ back
                gamma[a : a + n] *= beta
                here[:n] *= beta
            following = here
        emit = np.stack([np.bincount(self.symbols, gamma[:, s], p.emit.shape[1]) for s in range(len(p.initial))])
        return gamma[: parts[0][1]].sum(axis=0), moves * p.move, emit, float(np.log10(scales).sum())


def _sheaves(batches: Iterator[pa.RecordBatch], most: int = BATCH_TOKENS) -> Iterator[tuple[list, _Sheaf]]:
    """(row numbers, sequences) from batches of (row, symbols); sequences of similar length go together."""
    for batch in batches:
        rows = batch.column(0).to_pylist()
        sequences = [np.frombuffer(s, dtype="<u2") for s in batch.column(1).to_pylist()]
        order = sorted(range(len(rows)), key=lambda i: len(sequences[i]))
        group: list[int] = []
        size = 0
        for i in order:
            if group and size + len(sequences[i]) > most:
                yield [rows[j] for j in group], _Sheaf([sequences[j] for j in group])
                group, size = [], 0
            group.append(i)
            size += len(sequences[i])
        if group:
            yield [rows[j] for j in group], _Sheaf([sequences[j] for j in group])


def train(sequences: DataFrame, words: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> tuple[Parameters, list[float]]:
    """Parameters after ``rounds`` of Baum and Welch over ``sequences(row, symbols)``, and log10 likelihood before each.

    A round is one job: every task adds up the expected counts of its rows, Spark adds up the tasks' counts per symbol,
    and the driver gets one row per symbol. Emissions are mixed with the training shares, so none becomes zero.
    """
    context = sequences.sparkSession.sparkContext
    p = start_parameters(words, states)
    share, prior = _shares(words), 50.0
    likelihoods = []
    sums = [f"s{i}" for i in range(states)]
    for _ in range(rounds):
        shared = context.broadcast(p)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            k, size = len(p.initial), p.emit.shape[1]
            table = np.zeros((size + k + 2, k))  # symbols, moves, first states, likelihood
            seen = False
            for _, sheaf in _sheaves(batches):
                first, moves, emit, likelihood = sheaf.expected(p)
                table[:size] += emit.T
                table[size : size + k] += moves
                table[size + k] += first
                table[size + k + 1, 0] += likelihood
                seen = True
            if seen:
                keys = np.flatnonzero(table.any(axis=1))
                columns = [pa.array(keys.astype(np.int32))] + [pa.array(table[keys, i].astype(np.float32)) for i in range(k)]
                yield pa.RecordBatch.from_arrays(columns, ["key", *(f"s{i}" for i in range(k))])

        partial = sequences.mapInArrow(count, "key int, " + ", ".join(f"{s} float" for s in sums))
        rows = partial.groupBy("key").agg(*[F.sum(s).alias(s) for s in sums]).collect()
        size = words.size
        table = np.zeros((size + states + 2, states))
        for r in rows:
            table[r["key"]] = [r[s] for s in sums]
        likelihoods.append(float(table[-1, 0]))
        emit = table[:size].T + prior * share
        move = table[size : size + states] + 1.0
        first = table[size + states] + 1.0
        p = Parameters(
            first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)
        )
        shared.unpersist()
    return p, likelihoods


def scored(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)``; training rows are those that ``held_out`` does not take.

    Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row of ``docs``. ``score`` is
    the log10 probability of the text's words and end: the forward likelihood of its symbols, and for each word without
    a symbol of its own the share of that word in its class. A class gives the share of its words that occur once to
    words never seen in training (Good and Turing's estimate). NULL and empty texts are an end alone; without training
    rows every symbol is equally likely.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    counts = materialize(word_counts(docs), "word-counts")
    words = lexicon(counts, head)
    rows = materialize(encoded(docs, words), "symbols")
    parameters, _ = train(rows.where(~F.col("held_out")).select("row", "symbols"), words, states, rounds)
    shared = spark.sparkContext.broadcast(parameters)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, sheaf in _sheaves(batches):
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(sheaf.log10(shared.value))], ["row", "latent"])

    latent = rows.select("row", "symbols").mapInArrow(likelihood, "row long, latent double")
    tail = rows.select("row", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("t"))
    tail = tail.select("row", F.col("t.tail_words").alias("word"), F.col("t.tail_counts").alias("times"))
    tail = tail.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    seen = spark.createDataFrame(
        [(k, float(t), float((s + 1) / (t + 2)) if t else 1.0) for k, (t, s) in enumerate(zip(words.class_tokens, words.class_single))],
        "k int, tokens double, unseen double",
    )
    tail = tail.withColumn("k", _class_column("word")).join(F.broadcast(seen), "k")
    share = F.when(F.col("c") > 0, F.col("c") / F.col("tokens") * (1 - F.col("unseen"))).otherwise(F.col("unseen"))
    base = F.log10((F.col("c") + 1) / F.lit(float(words.tokens + words.distinct + 1)))
    tail = tail.groupBy("row").agg(
        F.sum(F.col("times") * base).alias("base_tail"), F.sum(F.col("times") * F.log10(share)).alias("share_tail"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_tail"),
    )
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "n_head", "base_head").join(latent, "row").join(tail, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base_head") + F.coalesce("base_tail", zero)).alias("base_score"),
        (F.col("latent") + F.coalesce("share_tail", zero)).alias("score"),
    )
