"""Encoding into and decoding from the pieces of a SentencePiece model.

The best segmentation by piece scores is found by Viterbi's recursion, driven by an Aho-Corasick automaton over the
pieces: one pass over the text, following the output links at each position to all pieces that end there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import map_texts, texts

SPACE = "▁"
KNOWN_WORDS = 400_000  # words whose pieces a task remembers before it starts anew
UNKNOWN_PENALTY = 10.0  # below the lowest score, for a character that no piece covers

_models: dict[str, "Model"] = {}


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    automaton: ahocorasick.Automaton
    byte_ids: list[int] | None
    unknown: int
    unknown_score: float
    texts: list[bytes]  # what each piece decodes to
    by_word: bool  # no piece continues after a space that follows other characters, or has a line end
    known: dict[str, tuple[bytes, int, float, int]] = field(default_factory=dict)


def load(path: str) -> Model:
    """The model of a file, built once per Python worker."""
    if path not in _models:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        names, scores = [p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)]
        automaton = ahocorasick.Automaton()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        for i in plain:
            automaton.add_word(names[i], (len(names[i]), scores[i], i))
        automaton.make_automaton()
        by_byte = {names[i]: i for i in range(n) if p.is_byte(i)}
        byte_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else None
        worst = min((scores[i] for i in plain), default=0.0)
        by_word = not any(SPACE in names[i].lstrip(SPACE) or "\n" in names[i] for i in plain)
        out = [b"" if p.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        out[p.unk_id()] = " \u2047 ".encode()
        for byte, i in enumerate(byte_ids or ()):
            out[i] = bytes([byte])
        _models[path] = Model(names, scores, automaton, byte_ids, p.unk_id(), worst - UNKNOWN_PENALTY, out, by_word)
    return _models[path]


def viterbi(model: Model, text: str) -> tuple[list[tuple[int, int, int]], float]:
    """Best segmentation as (piece id or -1, start, end), and its score. Among equal scores the longer last piece wins.

    ``best[e]`` is the best score of the first ``e`` characters. The automaton yields the pieces that end at a
    position from the longest on; a character that ends no piece reaching back to a scored position is unknown.
    """
    n = len(text)
    best, start, via = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    done = 0  # positions scored so far
    unknown = model.unknown_score
    for last, (length, score, piece) in model.automaton.iter(text):
        end = last + 1
        while done < end:
            best[done + 1], start[done + 1] = best[done] + unknown, done
            done += 1
        value = best[end - length] + score
        if value > best[end]:
            best[end], start[end], via[end] = value, end - length, piece
    while done < n:
        best[done + 1], start[done + 1] = best[done] + unknown, done
        done += 1
    path, end = [], n
    while end:
        path.append((via[end], start[end], end))
        end = start[end]
    return path[::-1], best[n]


def _ids(model: Model, text: str) -> tuple[bytes, int, float, int]:
    """Ids as little-endian 32-bit numbers, how many, score, and how many characters no piece covers.

    Such a character becomes its bytes' pieces, or, without these, a run of them one unknown piece.
    """
    path, score = viterbi(model, text)
    ids: list[int] = []
    missed = 0
    for piece, start, end in path:
        if piece >= 0:
            ids.append(piece)
            continue
        missed += 1
        if model.byte_ids:
            ids += [model.byte_ids[b] for b in text[start:end].encode()]
        elif not ids or ids[-1] != model.unknown:
            ids.append(model.unknown)
    return np.array(ids, dtype="<u4").tobytes(), len(ids), score, missed


def _words(text: str) -> list[str]:
    """Line ends, and runs of spaces with what follows each, from a text in which SPACE stands for a space."""
    out: list[str] = []
    for i, line in enumerate(text.split("\n")):
        out += ["\n"] * (i > 0) + _words_of_line(line)
    return out


def _words_of_line(text: str) -> list[str]:
    parts = text.split(SPACE)
    out, spaces = [parts[0]] if parts[0] else [], 0
    for part in parts[1:]:
        spaces += 1
        if part:
            out.append(SPACE * spaces + part)
            spaces = 0
    if spaces:
        out.append(SPACE * spaces)
    return out


def encode_text(model: Model, text: str) -> tuple[bytes, int, float, int]:
    """As ``_ids``, for a raw text: a space is put before it and spaces become SPACE. An empty text has no pieces.

    Where no piece spans the end of a word, the best segmentation is that of the words, and equal words are done once.
    """
    if not text:
        return b"", 0, 0.0, 0
    text = SPACE + text.replace(" ", SPACE)
    if not model.by_word:
        return _ids(model, text)
    known, parts = model.known, _words(text)
    if len(known) > KNOWN_WORDS:
        known.clear()
    found = []
    for word in parts:
        got = known.get(word)
        if got is None:
            got = known[word] = _ids(model, word)
        found.append(got)
    ids, counts, scores, missed = zip(*found)
    return b"".join(ids), sum(counts), sum(scores), sum(missed)


def decode_ids(model: Model, ids: bytes | list[int]) -> str:
    """Text of the ids: byte pieces are joined to characters, spaces restored, the first one taken off."""
    numbers = np.frombuffer(ids, dtype="<u4").tolist() if isinstance(ids, bytes) else ids
    pieces = model.texts
    return b"".join([pieces[i] for i in numbers]).decode("utf-8", "replace").removeprefix(" ")


def _path_on_executor(path: str) -> str:
    """The model file, where it lies on this machine or as sent with ``addFile``."""
    import os

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, score) of every row of ``docs(doc_id, text)``; NULL and empty texts have no ids and score 0."""

    def step(doc_ids, data):
        model = load(_path_on_executor(model_path))
        got = [encode_text(model, t.decode()) for t in data]
        ids = [np.frombuffer(g[0], dtype="<i4") for g in got]
        columns = [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([g[2] for g in got])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "score"])

    return map_texts(texts(docs), step, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from ``encoded(doc_id, ids)``; a NULL list gives a NULL text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = load(_path_on_executor(model_path))
            out = [None if ids is None else decode_ids(model, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )


def encoded_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, n_uncovered, ids_crc32, score, round_trip) of every row of ``docs(doc_id, text)``.

    ``n_uncovered`` are characters that no piece covers, ``ids_crc32`` is over the ids as little-endian 32-bit numbers,
    ``round_trip`` says that decoding the ids gives the text back.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_uncovered", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()),
        ("round_trip", pa.bool_()),
    ])

    def step(doc_ids, data):
        model = load(_path_on_executor(model_path))
        rows = []
        for doc_id, raw in zip(doc_ids, data):
            text = raw.decode()
            ids, n, score, missed = encode_text(model, text)
            rows.append((doc_id, n, missed, zlib.crc32(ids), score, decode_ids(model, ids) == text))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return map_texts(
        texts(docs), step, "doc_id long, n_ids long, n_uncovered long, ids_crc32 long, score double, round_trip boolean"
    )
