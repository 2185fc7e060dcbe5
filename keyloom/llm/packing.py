"""Packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.common import map_texts, texts
from keyloom.session import materialize

CAPACITY = 4096
END_ID = 1
KNOWN_WORDS = 400_000  # words, and parts of words, whose ids a task remembers before it starts anew
RANKED = 1_000  # pieces of one length that one task ranks

LINE_WORDS = 256  # new words given to the tokenizer as one text
MARK = "|"  # stands between them; a word with it is a text of its own

# Words of ASCII and of the letters of Latin-1: composed already, with one lower-case letter for each capital.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PLAIN_LINES = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# Fixed value: line ends, and the parts that the public word_bpe tokenizer cuts such a word into once it is lower-cased.
PARTS = "\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+"
_PARTS = re.compile(PARTS)
LINE_END = b"\xff\xff\xff\xff"  # ids stay below 2**24, so no four bytes of them in a row are these

_tokenizers: dict[str, "_Words"] = {}


class _Words:
    """A tokenizer and the ids of the words that this Python worker has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")  # each is found before a text is cut
        self.short = None
        if self._cuts_as_expected():
            # The same model without the steps before it: parts come lower-cased, composed and cut already.
            self.short = Tokenizer(self.tokenizer.model)
            self.short.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = self.tokenizer.get_vocab()
            assert max(vocab.values()) < 1 << 24
            self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a part
            self.last[[i for t, i in vocab.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
            self.byte_signs = {b: chr(c) for b, c in _byte_signs().items()}

    def _cuts_as_expected(self) -> bool:
        """Whether the steps before the model are those that PARTS stands for."""
        import json

        made = json.loads(self.tokenizer.to_str())
        steps = [(made["normalizer"] or {}).get("normalizers", []), (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        found = [[s["type"] for s in x] for x in steps]
        if found != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or not made["model"].get("end_of_word_suffix"):
            return False
        split, signs = steps[1]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return split["pattern"] == {"Regex": pattern} and split["behavior"] == "Removed" and split["invert"] and not signs["add_prefix_space"]

    def learn(self, words: list[bytes]) -> None:
        """Work out the ids of words not yet known."""
        if self.short is not None:
            text = b"\n".join(words).decode("utf-8", "replace")
            if not _PLAIN_LINES.fullmatch(text) or self.special.search(text):
                plain = [bool(_PLAIN.fullmatch(t)) and not self.special.search(t) for t in text.split("\n")]
                rest = [w for w, fits in zip(words, plain) if not fits]
                words = [w for w, fits in zip(words, plain) if fits]
                text = b"\n".join(words).decode("utf-8", "replace")
            else:
                rest = []
            if words:
                self._learn_plain(words, text)
            words = rest
        if words:
            self.known.update(zip(words, _encode_words(self.tokenizer, [w.decode("utf-8", "replace") for w in words])))

    def _learn_plain(self, words: list[bytes], text: str) -> None:
        """The same for plain words, given as lines of a text too. An id that no vocabulary has stands for a line end."""
        found = _PARTS.findall(text.lower())
        if len(self.parts) > KNOWN_WORDS:
            self.parts.clear()
        self.parts["\n"] = LINE_END
        new = list(set(found).difference(self.parts))
        if new:
            self.parts.update(zip(new, self._encode_parts(new)))
        self.known.update(zip(words, b"".join(map(self.parts.__getitem__, found)).split(LINE_END)))

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part: parts are given in lines, and end at an id that ends a word."""
        signs = [p if p.isascii() else p.encode().decode("latin-1").translate(self.byte_signs) for p in parts]
        lines = [" ".join(signs[i : i + LINE_WORDS]) for i in range(0, len(signs), LINE_WORDS)]
        out: list[bytes] = []
        for n, found in enumerate(self.short.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            raw, stops = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            own = parts[n * LINE_WORDS : (n + 1) * LINE_WORDS]
            if len(stops) != len(own) or stops[-1] != len(raw):
                raise ValueError("the tokenizer's ids do not end where words end")
            out += [raw[a:b] for a, b in zip([0, *stops], stops)]
        return out


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


def _words(path: str) -> _Words:
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path)
    return _tokenizers[path]


def encode(path: str, data: list[bytes]) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers, without an end id.

    The tokenizer drops ASCII white space before it looks for pieces and none of its pieces or special tokens spans any, so
    the ids of a text are those of its words; equal words are encoded once. Plain words are cut into their parts here, and
    equal parts are encoded once; all other words go through the whole tokenizer.
    """
    words = _words(path)
    split = [text.split() for text in data]
    if len(words.known) > KNOWN_WORDS:
        words.known.clear()
    known = words.known
    words.learn(list(set().union(*split).difference(known)))
    return [b"".join(map(known.__getitem__, found)) for found in split]


def _encode_words(tokenizer, words: list[str]) -> list[bytes]:
    """Ids of each word. Words are given in lines, as a call per word costs twice the time, and cut at the mark's id."""
    encode = tokenizer.encode_batch_fast
    mark = encode([MARK], add_special_tokens=False)[0].ids
    out = [b""] * len(words)
    marked = [i for i, w in enumerate(words) if MARK in w or len(mark) != 1]
    plain = [i for i, w in enumerate(words) if not (MARK in w or len(mark) != 1)]
    lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
    for line, found in zip(lines, encode([f" {MARK} ".join([words[i] for i in x]) for x in lines], add_special_tokens=False)):
        ids = np.array(found.ids, dtype="<u4")
        raw, stops = ids.tobytes(), (np.flatnonzero(ids == mark[0]) * 4).tolist()
        for i, a, b in zip(line, [0, *(x + 4 for x in stops)], [*stops, len(raw)]):
            out[i] = raw[a:b]
    for i, found in zip(marked, encode([words[i] for i in marked], add_special_tokens=False)):
        out[i] = np.array(found.ids, dtype="<u4").tobytes()
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs(doc_id, text)``.

    A document is its ids and the end id; a longer one than ``capacity`` is cut. NULL and empty texts are one end id.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ])
    end = END_ID.to_bytes(4, "little")

    def step(ids, data):
        rows = []
        for doc_id, found in zip(ids, encode(tokenizer_path, data)):
            found += end
            for start in range(0, len(found), 4 * capacity):
                part = found[start : start + 4 * capacity]
                rows.append((doc_id, start // (4 * capacity), start // 4, len(part) // 4, zlib.crc32(part)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return map_texts(texts(docs), step, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how often each goes into the fullest bin that holds the largest length left.

    Bit s of a number says that the bin can be filled to s. Lengths are added from the largest one on, each as often as
    it is there, in powers of two; the search ends at a full bin. Going back through the steps gives the combination.
    """
    largest = max(counts)
    reach, steps = 1 << largest, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == largest), (capacity - largest) // length)
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << (length * times) & mask
            left -= times
            times *= 2
        if reach >> capacity:
            break
    at = reach.bit_length() - 1
    chosen = {largest: 1}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + times
            at -= length * times
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, combination of each) that use up ``counts``: a combination is repeated while its lengths last.

    Each entry leaves less of some length than the combination takes, so the list is about as long as there are
    different lengths, however many pieces there are.
    """
    counts = {length: n for length, n in counts.items() if n > 0}
    out = []
    while counts:
        chosen = fullest(counts, capacity)
        bins = min(counts[length] // times for length, times in chosen.items())
        for length, times in chosen.items():
            counts[length] -= bins * times
            if not counts[length]:
                del counts[length]
        out.append((bins, chosen))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Columns of ``items(doc_id, piece, length, ...)`` with sequence_id and offset.

    Only the number of items of each of the at most ``capacity`` lengths reaches the driver. Items of one length are
    interchangeable: they are ranked (in hashed parts of bounded size, so a length that a third of all items share is
    no single task's work) and their rank says which place of the plan is theirs. Lengths outside 1..capacity raise.
    """
    sizes = items.groupBy("length").count().collect()
    if any(not 1 <= r["length"] <= capacity for r in sizes):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    spark = items.sparkSession
    parts = spark.createDataFrame([(r["length"], -(-r["count"] // RANKED)) for r in sizes], "length long, _parts int")
    dealt = items.join(F.broadcast(parts), "length").withColumn(
        "_part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_parts")).cast("int")
    )
    counted = dealt.groupBy("length", "_part").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_rank", F.row_number().over(own) - 1).join(counted, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    places = _places(plan({r["length"]: r["count"] for r in sizes}, capacity))
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, base, copies, offset = places
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length.astype(np.int64) << 48) + rank, side="right") - 1
            bins, slot = np.divmod(rank - first[at], copies[at])
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(base[at] + bins), pa.array(offset[at] + slot * length)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "_rank").mapInArrow(place, schema)


def _places(bins: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """For each length and first rank: first rank, first sequence, copies in a sequence, offset of the first copy."""
    rows, used, sequence = [], {}, 0
    for number, chosen in bins:
        offset = 0
        for length, times in chosen.items():
            first = used.get(length, 0)
            rows.append(((length << 48) + first, first, sequence, times, offset))
            used[length] = first + number * times
            offset += length * times
        sequence += number
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return tuple(table.T.copy())


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Rows that repeat a doc_id are
    documents of their own; an empty table gives no rows.
    """
    return pack(materialize(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
