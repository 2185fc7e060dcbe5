"""Merkle manifest of a dataset: content-addressed records, and proofs by descent from the root.

Rows are leaves; runs of ``FAN`` neighbouring nodes become one node until one is left. Each group has a tree of its own,
and the group roots, in the order of the groups, are the leaves of one more tree. What is stored is, per level, the
digest of a node and the digests of its children. A proof is read by going down from the root along the digits of a
leaf's rank; requests that share digits go down together, and part at the node where their digits differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.session import materialize

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Trees:
    """Trees of all groups: ``levels[k]`` has the nodes of height k + 1 as (grp, idx, digest, children)."""

    levels: list[DataFrame]
    roots: DataFrame  # (grp, digest, height)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """Unambiguous text of a value: ``-`` for NULL, else its length in bytes and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0, within their group by ``order`` (NULLs first), written to the shared folder.

    Rows are sorted in ranges over all groups, so a group that holds most rows is spread over many tasks; equal rows are
    told apart by where they were read. A place in a range and the sizes of the ranges before it make the rank.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie").asc()]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    # The id is the number of the range in the upper bits and the place in it in the lower 33.
    ranges = materialize(ranges.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_id", 33))
    sizes = ranges.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of"))
    out = ranges.join(sizes, same).withColumn("rank", F.col("_id") - F.col("_first") + F.col("_before"))
    return out.drop("_id", "_range", "_group", "_of", "_first", "_before")


def planted(leaves: DataFrame, sizes: DataFrame) -> Trees:
    """Trees over ``leaves(grp, rank, digest)`` of the group sizes ``sizes(grp, n)``.

    A node's children meet at (grp, rank / FAN), at most ``FAN`` rows, so no group is gathered; the rows of a level are a
    sixteenth of those below. Only the largest size reaches the driver.
    """
    most = sizes.agg(F.max("n")).head()[0] or 0
    nodes = leaves.join(sizes, "grp").select("grp", F.col("rank").alias("idx"), "digest", "n")
    levels, roots, height = [], [], 0
    while True:
        roots.append(nodes.where("n = 1").select("grp", "digest", F.lit(height).alias("height")))
        if most <= 1:
            break
        runs = nodes.where("n > 1").groupBy("grp", F.expr(f"idx div {FAN}").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.first("n").alias("n")
        )
        made = runs.select(
            "grp", F.col("up").alias("idx"), F.transform("run", lambda x: x.digest).alias("children"),
            F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
        ).withColumn("digest", digest(F.array_join("children", "")))
        nodes = materialize(made, "merkle-level")
        levels.append(nodes.drop("n"))
        most, height = -(-most // FAN), height + 1
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Trees(levels, found)


def gone_down(start: DataFrame, levels: list[DataFrame], requests: DataFrame, to: int) -> DataFrame:
    """Nodes of height ``to`` that lie above requested leaves, with the runs and digits on the way from the root.

    ``start(grp, height, digest, runs, digits)`` are roots, ``requests(grp, rank)`` the leaves. At each height the
    digest of a node finds its record; its children become rows if a request lies below them. Result: (grp, idx,
    digest, runs, digits); roots that are not as high as ``to`` are left out.
    """
    wanted = [requests.select("grp", F.col("rank").alias("idx"))]
    for _ in levels:
        up = wanted[-1].select("grp", F.expr(f"idx div {FAN}").alias("idx")).distinct()
        wanted.append(up)
    at = None
    for height in range(len(levels), to - 1, -1):
        here = start.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("idx"), "digest", "runs", "digits")
        at = here if at is None else at.unionByName(here)
        if height == to:
            break
        children = at.join(_records(levels[height - 1]), "digest").select(
            "grp", F.col("idx").alias("up"), F.array_append("runs", F.col("children")).alias("runs"), "digits",
            F.posexplode("children").alias("digit", "digest"),
        )
        below = children.select(
            "grp", (F.col("up") * FAN + F.col("digit")).alias("idx"), "digest", "runs",
            F.array_append("digits", F.col("digit")).alias("digits"),
        )
        at = below.join(wanted[height - 1], ["grp", "idx"], "left_semi")
    return at


def _records(level: DataFrame) -> DataFrame:
    """Digest to children, each digest once."""
    return level.groupBy("digest").agg(F.first("children").alias("children"))


def proofs(trees: Trees, roots: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(grp, rank, ...)`` with the runs and digits on the way to each of them, and the group's ``subroot``.

    ``roots(grp, digest, height, runs, digits)`` says where the descent begins. In the last step the requests join the
    record above them, so the runs are not copied per leaf before they are used.
    """
    subroots = roots.select("grp", F.col("digest").alias("subroot"), "height")
    alone = roots.where("height = 0").select("grp", "runs", "digits", F.col("digest").alias("subroot"))
    found = requests.join(alone, "grp")
    if trees.levels:
        above = gone_down(roots, trees.levels, requests, 1).join(_records(trees.levels[0]), "digest")
        above = above.select(
            "grp", F.col("idx").alias("_up"), F.array_append("runs", F.col("children")).alias("runs"), "digits",
        ).join(subroots.select("grp", "subroot"), "grp")
        last = requests.withColumn("_up", F.expr(f"rank div {FAN}")).join(above, ["grp", "_up"])
        digit = F.expr(f"cast(rank % {FAN} as int)")
        last = last.withColumn("digits", F.array_append("digits", digit)).drop("_up")
        found = found.unionByName(last)
    return found


def steps(runs: str = "runs", digits: str = "digits") -> Column:
    """Runs with the place of the own node, from the leaf to the root."""
    return F.reverse(F.arrays_zip(F.col(runs).alias("run"), F.col(digits).alias("digit")))


def siblings(path: Column) -> Column:
    """All digests of a path but the own ones, concatenated from the leaf to the root, each run left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.filter(s.run, lambda x, i: i != s.digit))), "")


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its siblings give."""

    def up(node, s):
        left = F.array_join(F.slice(s.run, F.lit(1), s.digit), "")
        right = F.array_join(F.slice(s.run, s.digit + 2, F.lit(FAN)), "")
        return digest(F.concat(left, node, right))

    return F.aggregate(path, leaf, up)


def verified(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source"
) -> DataFrame:
    """Manifest of ``docs`` with the proof of every row, checked against rows of which some were tampered with.

    One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where 5 divides the crc32 of
    the id, the leaf that is checked has the text's A-Z in lower case. NULLs in any column are hashed as ``-``, a NULL
    source is the first group, rows that repeat a doc_id stand next to each other ordered by leaf, and an empty table has
    no rows. Columns that are not named take no part.
    """
    key = F.col("doc_id").cast("string")
    hit = F.crc32(F.coalesce(key, F.lit("")).cast("binary")) % 5 == 0
    lowered = [F.translate(F.col(c).cast("string"), UPPER, LOWER) if c == "text" else F.col(c) for c in columns]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(group).cast("string").alias("_source"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"), F.when(hit, leaf_digest(lowered)).alias("tampered"),
    )
    ranked = materialize(numbered(rows, "_source", ["doc_id", "digest"]), "merkle-leaves")
    sizes = ranked.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    sizes = materialize(numbered(sizes, "_all", ["_source"]).withColumnRenamed("rank", "grp"), "merkle-groups")
    if sizes.isEmpty():
        nothing = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], nothing)
    same = F.col("_source").eqNullSafe(F.col("_named"))
    grouped = ranked.join(sizes.select("grp", F.col("_source").alias("_named")), same).drop("_source", "_named")
    grouped = materialize(grouped, "merkle-grouped")
    below = planted(grouped.select("grp", "rank", "digest"), sizes.select("grp", "n"))
    subroots = materialize(below.roots, "merkle-subroots")
    top_sizes = sizes.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("grp"), "n")
    heads = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("rank"), "digest")
    top = planted(heads, top_sizes)
    top_roots = top.roots.withColumn("runs", F.lit(None).cast("array<array<string>>")).withColumn("digits", F.lit(None).cast("array<int>"))
    top_roots = top_roots.withColumn("runs", F.coalesce("runs", F.array().cast("array<array<string>>")))
    top_roots = materialize(top_roots.withColumn("digits", F.coalesce("digits", F.array().cast("array<int>"))), "merkle-root")
    root = top_roots.head()["digest"]
    reached = proofs(top, top_roots, heads.select("grp", "rank")).select(F.col("rank").alias("grp"), "runs", "digits")
    starts = materialize(subroots.join(reached, "grp"), "merkle-starts")
    found = proofs(below, starts, grouped).withColumn("path", steps()).drop("runs", "digits")
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"),
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
