"""Secret scan: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

All on column expressions. Text is read once; what is written of it are the spans of the patterns, the long tokens beside
them with their places, and the distinct identifiers the second model learns from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import let
from keyloom.session import materialize

# The base patterns. Letters in either case are spelled out, so that no engine folds other letters.
KEYWORD = "".join(f"[{c.upper()}{c}]" for c in "password") + "|" + "".join(f"[{c.upper()}{c}]" for c in "passwd")
KEYWORD += "|" + "".join(f"[{c.upper()}{c}]" for c in "secret") + "|" + "".join(f"[{c.upper()}{c}]" for c in "token")
KEYWORD += "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of 20 and more that AKIA[A-Z0-9]+ finds
HEX = r"[0-9a-f]{24,}"  # the runs of 24 and more that [0-9a-f]+ finds
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_=-]"
LONG = 16  # characters of the tokens that are compared with the models
NAME = 8  # characters of the identifiers that the second model learns from

# The characters a token may have, letters folded, and what stands before its first one.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
START = len(SYMBOLS)
SPAN = "struct<start:int,kind:int,stop:int,text:string>"
BLOCK = 256  # numbers that one list of running sums holds


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratios, random over ordinary, of each character after each other one, and what a text must reach."""

    ratios: tuple[float, ...]  # at before * len(SYMBOLS) + after; before may be START
    least: float


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Places of the leftmost non-overlapping matches, in code points, with what they match.

    What lies between the matches and the matches themselves, one after the other, give the places.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(p: Column) -> Column:
        steps = F.zip_with(p["found"], F.slice(p["gaps"], F.lit(1), F.size(p["found"])), lambda m, g: F.length(m) + F.length(g))
        return F.zip_with(p["found"], running(steps), lambda m, stop: F.struct(
            (stop - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), m.alias("text"),
        ))

    none = F.array().cast(f"array<{SPAN}>")
    out = F.when(F.rlike(text, F.lit(pattern)), let(parts, placed)).otherwise(none)
    return out if keep is None else F.filter(out, keep)


def running(steps: Column) -> Column:
    """Sums of the first 1, 2, ... numbers. Lists grow only within blocks, so long ones do not take the square of their size."""

    def sums(numbers: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
        return F.aggregate(numbers, empty, add, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: sums(b, F.coalesce(F.get(t, i - 1), F.lit(0))))))

    starts = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    return let(F.transform(starts, lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))), joined)


def assigned(match: Column) -> Column:
    """The value in a match of ``ASSIGN``."""
    return F.regexp_extract(match, ASSIGN, 2)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens, names): base spans by start and kind, long tokens that touch none, identifiers beside them.

    Written to the shared folder: texts are read once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(
        spans(text, ASSIGN, "assign", lambda s: F.length(assigned(s["text"])) >= 6), spans(text, ACCESS, "access"), spans(text, HEX, "hex"),
    )
    plain = text
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sort_array(base).alias("base"),
        spans(text, f"{TOKEN}{{{LONG},}}", "random").alias("long"),
        F.array_distinct(F.regexp_extract_all(plain, F.lit(f"{TOKEN}{{{NAME},}}"), F.lit(0))).alias("names"),
    )
    return materialize(rows, "secret-scan")


def samples(scan: DataFrame) -> DataFrame:
    """Labelled texts (text, random), each once: the values that the patterns name, and the identifiers beside them."""
    value = F.transform("base", lambda s: F.when(s["kind"] == KINDS.index("assign"), assigned(s["text"])).otherwise(s["text"]))
    secret = scan.select(F.explode(value).alias("text")).distinct().withColumn("random", F.lit(True))
    ordinary = scan.select(F.explode("names").alias("text")).distinct().withColumn("random", F.lit(False))
    return secret.unionByName(ordinary)


def _symbols(text: Column) -> Column:
    """Number of each character, letters folded; others than SYMBOLS are left out."""
    numbers = F.transform(F.split(F.lower(text), ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    return F.filter(numbers, lambda n: n >= 0)


def learned(labelled: DataFrame, prior: float = 1.0, uniform: float = 0.5, confidence: float = 0.999, least_length: int = 1) -> Models:
    """Both models from ``labelled(text, random)``: counts of neighbouring characters, added up over all rows.

    Each model adds ``prior`` to every count. The random one is mixed with the uniform distribution (a share of
    ``uniform``), as random strings of other alphabets than the samples' have no other structure. A text is taken for
    random where the ratio of its likelihoods outweighs the shares of both labels and the odds of ``confidence``. Rows
    without text or label take no part; at most 42 x 41 counts of each label reach the driver. Without samples of a label
    its model is uniform.
    """
    width = len(SYMBOLS)
    known = labelled.where("text IS NOT NULL AND random IS NOT NULL").select("random", _symbols(F.col("text")).alias("s"))
    known = known.where(F.size("s") >= least_length)
    moves = known.select("random", F.explode(F.zip_with(
        F.concat(F.array(F.lit(START)), F.slice("s", F.lit(1), F.size("s") - 1)), "s", lambda a, b: a * width + b
    )).alias("move"))
    counts = {True: [0] * (width * (width + 1)), False: [0] * (width * (width + 1))}
    for r in moves.groupBy("random", "move").count().collect():
        counts[r["random"]][r["move"]] = r["count"]
    texts = {r["random"]: r["count"] for r in known.groupBy("random").count().collect()}

    def chances(label: bool) -> list[float]:
        out = []
        for before in range(width + 1):
            row = counts[label][before * width : (before + 1) * width]
            out += [(n + prior) / (sum(row) + prior * width) for n in row]
        return out

    pairs = zip(chances(True), chances(False))
    ratios = tuple(math.log((1 - uniform) * p + uniform / width) - math.log(q) for p, q in pairs)
    shares = math.log((texts.get(False, 0) + 1) / (texts.get(True, 0) + 1))
    return Models(ratios, max(0.0, shares) + math.log(confidence / (1 - confidence)))


def ratio(text: Column, models: Models) -> Column:
    """Log-likelihood ratio of a text: above 0 it is more like the random samples."""
    table = F.array(*[F.lit(x) for x in models.ratios])
    width = len(SYMBOLS)
    start = F.struct(F.lit(START).alias("before"), F.lit(0.0).alias("sum"))
    step = lambda acc, n: F.struct(n.alias("before"), (acc["sum"] + F.get(table, acc["before"] * width + n)).alias("sum"))
    return F.aggregate(_symbols(text), start, step, lambda acc: acc["sum"])


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def found_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Spans of secrets in every text of ``docs(doc_id, text)``: (doc_id, spans), with what each span holds.

    ``spans`` are (start, kind, stop, text) in that order, in code points: those of the patterns, and tokens of
    ``LONG`` characters or more that touch none of them and that the models take for random. The models learn from
    ``labelled(text, random)``, or else from what the patterns found and the identifiers beside it. A NULL text has no
    spans; rows that repeat a doc_id stay rows of their own; an empty table has no rows.
    """
    scan = scanned(docs)
    models = learned(samples(scan) if labelled is None else labelled)
    apart = F.filter("long", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    random = F.filter(apart, lambda t: ratio(t["text"], models) > F.lit(models.least))
    return scan.select("doc_id", "base", F.sort_array(F.concat("base", F.when(F.size("long") > 0, random).otherwise(F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``; see :func:`found_secrets`."""
    found = found_secrets(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
