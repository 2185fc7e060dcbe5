"""Chat formatting with the perspective rotated over all speakers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import let
from keyloom.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
PART_TURNS = 256  # turn numbers in a part
PART_ROWS = 1024  # rows in a sub
ORDER = ("missing", "turn", "speaker", "text")  # of the turns in a dialogue


def rotated(turns: DataFrame) -> DataFrame:
    """Every dialogue as seen by each of its speakers, from ``turns(conv_id, turn, role, text)``.

    Rows (conv_id, perspective, part, sub, n_turns, n_masked, mask, text). In ``text`` the perspective's turns are the
    assistant's, system turns stay the system's, and every other speaker is a user with a name. ``mask`` lists the
    half-open code point ranges of ``text`` to learn from: the perspective's words and their end marks; ``n_masked``
    is their length. System is no speaker, so a dialogue of system turns alone has no rows.

    Turns are ordered by number, speaker and text; a NULL role is the speaker "unknown", a NULL text is empty, turns
    without a number come last, repeated rows are repeated turns, and NULL conversation ids are one conversation. A
    long dialogue comes in parts of 256 turn numbers; a part with very many rows (ties, as its numbers are few) in
    subs of 1024 rows, cut in the order of the dialogue. So no dialogue is one task's work, and the texts of all subs and
    parts, in the order of their numbers, are the whole dialogue. Masks count from the start of their own text.
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(1 << 53)).alias("part"), F.col("turn").isNull().alias("missing"),
    )
    large = said.groupBy("conv_id", "part").count().where(F.col("count") > PART_ROWS)
    large = large.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.lit(True).alias("large"))
    said = said.join(large, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    small = said.where("large IS NULL").select("conv_id", "part", F.lit(0).alias("sub"), *ORDER, F.lit(1).alias("times"))
    dealt = small.unionByName(_subs(said.where("large").drop("large")))
    turns = F.sort_array(F.collect_list(F.struct(*ORDER, "times")))
    turns = F.flatten(F.transform(turns, lambda t: F.array_repeat(t, t["times"])))
    parts = dealt.groupBy("conv_id", "part", "sub").agg(turns.alias("turns"))
    speakers = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"))
    seen = parts.join(speakers.distinct(), F.col("conv_id").eqNullSafe(F.col("c")))
    rendered = seen.select("conv_id", "perspective", "part", "sub", _render(F.col("turns"), F.col("perspective")).alias("r"))
    return rendered.select("conv_id", "perspective", "part", "sub", "r.n_turns", "r.n_masked", "r.mask", "r.text")


def _subs(said: DataFrame) -> DataFrame:
    """Rows (conv_id, part, sub, missing, turn, speaker, text, times): each part cut at every PART_ROWS-th of its rows in order.

    Repeated rows are counted first. The others are sorted into slices by ranges, so a row's rank is its rank in its slice
    after all rows of the part in earlier slices, and no task ranks a whole part.
    """
    key = ["conv_id", "part"]
    counted = said.groupBy(*key, *ORDER).agg(F.count(F.lit(1)).alias("all"))
    slices = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = counted.repartitionByRange(slices, *key, *ORDER).withColumn("slice", F.spark_partition_id())
    counted = materialize(counted, "chat-large-parts")
    earlier = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*key, "slice").agg(F.sum("all").alias("n")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("slice").alias("s"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("slice") == F.col("s"))
    within = Window.partitionBy(*key, "slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("within", F.sum("all").over(within)).join(sums, same)
    stop = F.col("before") + F.col("within")
    ranked = ranked.select(*key, *ORDER, (stop - F.col("all")).alias("start"), stop.alias("stop"))
    first, last = (F.floor(x / PART_ROWS) for x in (F.col("start"), F.col("stop") - 1))
    cut = ranked.withColumn("sub", F.explode(F.sequence(first, last)))
    times = F.least("stop", (F.col("sub") + 1) * PART_ROWS) - F.greatest("start", F.col("sub") * PART_ROWS)
    return cut.select(*key, F.col("sub").cast("int").alias("sub"), *ORDER, times.cast("int").alias("times"))


def _render(turns: Column, perspective: Column) -> Column:
    own = lambda t: t["speaker"] == perspective
    label = lambda t: (
        F.when(own(t), F.lit("assistant")).when(t["speaker"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), t["speaker"]))
    )
    segments = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(START), label(t), F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), own(t).alias("own"),
    ))
    return let(segments, _joined)


def _joined(segments: Column) -> Column:
    text = F.array_join(F.transform(segments, lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        span = F.array(F.struct(start.cast("long").alias("a"), end.cast("long").alias("b")))
        return F.struct(
            (end + 1).cast("long").alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    spans = F.aggregate(segments, empty, step)["spans"]
    return let(spans, lambda spans: F.struct(
        F.size(segments).cast("long").alias("n_turns"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["b"] - s["a"]).alias("n_masked"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["a"].cast("string"), s["b"].cast("string"))), ",").alias("mask"),
        text.alias("text"),
    ))
