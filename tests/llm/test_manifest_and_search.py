"""Merkle manifest against brute force, and on NULLs, repeated rows, ties, empty tables and clashing names."""

import hashlib
import string
import zlib

import pytest

from keyloom.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rank string, grp string, digest string, path string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, text, lang, source, n_chars) tuples."""

    def leaf(r, text):
        return sha(*[field(v) for v in (r[0], r[3], r[2], r[4], text)])

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = members, levels_of([leaf(r, r[1]) for r in members])
    top = levels_of([trees[s][1][-1][0] for s in order])
    out = []
    for si, s in enumerate(order):
        members, levels = trees[s]
        for i, r in enumerate(members):
            path = []
            for tree, at in ((levels, i), (top, si)):
                for level in tree[:-1]:
                    path.append((level[at // 16 * 16 : at // 16 * 16 + 16], at % 16))
                    at //= 16
            text = r[1]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
                text = text.translate(LOWER)
            node = leaf(r, text)
            for run, digit in path:
                node = sha(*run[:digit], node, *run[digit + 1 :])
            proof = sha(*[x for run, digit in path for j, x in enumerate(run) if j != digit])
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def same(got, want):
    return sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"Text {i} É", "en", "hot", i) for i in range(300)]
    out += [(i, "Other", None, f"s{i % 40}", None) for i in range(300, 360)]
    out += [(None, None, None, None, None), (7, None, "de", None, 3), (8, "", "", "", 0), (-5, "Minus", "x", "Ü", 1)]
    return out + [out[3], out[3], (3, "same id, other text", "en", "hot", 3), (9, "A" * 200_000, "en", "hot", 1)]


def test_merkle_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], COLUMNS).repartition(5)
    assert same(merkle.verified(docs).collect(), manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_merkle_small_tables(spark, rows, n):
    docs = spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows[:n]], COLUMNS)
    assert same(merkle.verified(docs).collect(), manifest(rows[:n]))


def test_merkle_requests_only(spark, rows):
    """A few requested leaves get the same paths as when all are requested."""
    leaves = spark.createDataFrame([(i % 3, i // 3, sha(str(i))) for i in range(900)], "grp long, rank long, digest string")
    sizes = leaves.groupBy("grp").count().withColumnRenamed("count", "n")
    trees = merkle.planted(leaves, sizes)
    empty = "cast(array() as array<array<string>>) AS runs", "cast(array() as array<int>) AS digits"
    roots = trees.roots.selectExpr("grp", "digest", "height", *empty)
    few = merkle.proofs(trees, roots, leaves.where("rank in (0, 17, 299)")).collect()
    assert len(few) == 9
    for r in few:
        node = r["digest"]
        for run, digit in zip(reversed(r["runs"]), reversed(r["digits"])):
            assert run[digit] == node
            node = sha(*run)
        assert node == r["subroot"]
        assert sum(d * 16**k for k, d in enumerate(reversed(r["digits"]))) == r["rank"]
