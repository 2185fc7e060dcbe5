"""Ranked search against brute force, how much its bounds leave out, and odd queries and texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import pair_bounds

COLUMNS = "doc_id long, text string, item long, score long, rank int, ids string, term string"


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def brute(docs, items, k=10):
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for (doc_id, c), n in zip(counts, sizes):
            m = 10 + 90 * n * n_docs // max(1, n_terms)
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return out


def same(got, want):
    return sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randrange(1, 120))) for i in range(900)]
    docs += [(i, docs[i - 900][1]) for i in range(900, 930)]  # ties
    docs += [docs[3], docs[3], (None, docs[5][1]), (None, None), (931, ""), (932, " \n -- "), (933, text(9000)), (934, "W1,w1;É|naïve")]
    items = [(i, text(rng.randrange(2, 25))) for i in range(25)]
    items += [(25, None), (26, "unknownword"), (27, "w0"), (3, "W7 w7 w8"), (None, "w5 w6"), (28, ""), (29, " ".join(words))]
    return docs, items


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 1, 1, "?", "?") for i, t in rows[0]], COLUMNS).repartition(4)
    items = spark.createDataFrame([(i, t, 5, "?") for i, t in rows[1]], "item_id long, text string, doc_id long, term string")
    return docs, items


def test_ranked_search(spark, rows, monkeypatch):
    docs, items = frames(spark, rows)
    want = brute(*rows)
    assert same(pair_bounds.search(docs, items).collect(), want)
    monkeypatch.setattr(pair_bounds, "BLOCK_BYTES", 700)  # several blocks of queries
    assert same(pair_bounds.search(docs, items).collect(), want)


def test_empty_tables(spark, rows):
    docs, items = frames(spark, rows)
    assert pair_bounds.search(docs.where("1 = 0"), items).count() == 0
    assert pair_bounds.search(docs, items.where("1 = 0")).count() == 0
    assert pair_bounds.search(docs.where("text IS NULL"), items).count() == 0


def test_bounds_hold_and_skip(spark, rows):
    """No document reaches more than the units' bounds, pairs tighten them, and few documents are scored."""
    docs, items = frames(spark, rows)
    block = next(pair_bounds.blocks(pair_bounds.query_terms(items)))
    shards = pair_bounds.counted(docs.coalesce(1), block.numbers)
    weight, n_docs, n_terms = pair_bounds.weights(shards, len(block.numbers))
    units, pairs = pair_bounds.paired(block, weight)
    index = pair_bounds.indexed(shards, weight, n_docs, n_terms, pairs)
    shard = pair_bounds.Shard(index.collect()[0].asDict(), len(block.numbers), len(pairs))
    tightened, scored, everything = 0, 0, 0
    for own in units:
        bound = shard.bounds(own)
        assert (bound <= shard.most[own.left] + shard.most[own.right]).all()
        tightened += int((bound < shard.most[own.left] + shard.most[own.right]).sum())
        for u in range(len(own.left)):
            score = np.zeros(len(shard.ids), np.int64)
            for t in (own.left[u], own.right[u]):
                place, impact = shard.list_of(t)
                score[place] += impact
            assert score.max() <= bound[u]
        _, all_scores, n_all = shard.best(own, 10, 0)
        if len(all_scores) == 10:
            place, again, n = shard.best(own, 10, int(all_scores[-1]))
            assert again.tolist() == all_scores.tolist()
            scored, everything = scored + n, everything + n_all
    assert tightened > 0 and scored < 0.7 * everything
