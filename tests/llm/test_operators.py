"""Operators against brute force, and on NULLs, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from keyloom.llm import (
    chat, decision_list, hmm, html_blocks, jaccard, packing, paragraphs, pieces, simhash, suffix_array, topk,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
EXTRA = ["component_id", "fp", "node", "key", "chunk", "found", "stats", "rank", "_new", "_text", "sequence_id"]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): copies, near copies, shared passages, odd texts and repeated rows."""
    rng = random.Random(5)
    base = [sentence(rng, rng.choice([3, 30, 90, 200])) for _ in range(40)]
    passage = sentence(rng, 60)
    texts = [*base, *base[:6], *(f"{sentence(rng, 15)} {passage} {sentence(rng, 9)}" for _ in range(6))]
    texts += [b.replace(" w1 ", " W1\n", 1) + " end" for b in base[10:20]]
    texts += [None, "", " \n\t", "x", "É\u0085Z  b A", "a" * 5000, "line one\nline one\nline one\n" * 9, sentence(rng, 6000, 50)]
    out = list(enumerate(texts))
    return out + [out[3], (None, base[7]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(i, t, "en", 1, *["?"] * len(EXTRA)) for i, t in rows]
    names = ["doc_id long", "text string", "lang string", "n_chars long", *(f"`{c}` string" for c in EXTRA)]
    return spark.createDataFrame(wide, ", ".join(names)).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("1 = 0")


def key(doc_id):
    return math.inf if doc_id is None else doc_id


def parts_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def test_simhash(docs, rows, nothing):
    def fingerprint(text):
        words = split(lower(text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    part = parts_of(range(len(rows)), near)
    least = defaultdict(lambda: math.inf)
    for i, (doc_id, _) in enumerate(rows):
        least[part[i]] = min(least[part[i]], key(doc_id))
    want = sorted((key(d), f"{prints[i]:016x}", least[part[i]]) for i, (d, _) in enumerate(rows))
    got = sorted((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0


def shingles(text, width=5):
    words = split(lower(text or ""))
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def similar(a, b):
    return a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9)


def test_one_of_each_group_stays(docs, rows, nothing):
    sets = [shingles(t) for _, t in rows]
    part = parts_of(range(len(rows)), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if similar(sets[i], sets[j])])
    least = defaultdict(lambda: math.inf)
    for i, (doc_id, _) in enumerate(rows):
        least[part[i]] = min(least[part[i]], key(doc_id))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == sorted(set(least.values()) - {math.inf})
    assert got.count(None) == 2
    assert simhash.keep_one(nothing).count() == 0


def test_repeats_inside_a_text_do_not_hide_copies(spark):
    rng = random.Random(11)
    texts = []
    for k in range(10):
        words, line = sentence(rng, 500, 10**6).split(), sentence(rng, 8, 10**6)
        once = f"{line} {line} {' '.join(words)}"
        words[250] = "changed"
        texts += [once, f"{' '.join([line] * 25)} {' '.join(words)}"]
        assert similar(shingles(texts[-1]), shingles(texts[-2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(0, 20, 2))


def test_sketches_of_similar_sets_are_near(spark):
    rng = random.Random(12)
    texts = []
    for size in (8, 9, 10, 12, 14, 20, 30, 60, 200):  # words; the last ones go, so few shingles are not shared
        for _ in range(60):
            words = sentence(rng, size, 10**6).split()
            texts += [" ".join(words), " ".join(words[: size - (size - 4) // 5])]
            assert similar(shingles(texts[-1]), shingles(texts[-2]))
    rows = simhash.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    prints = {r.doc_id: r[2:] for r in rows}
    apart = [sum(((x ^ y) % 2**64).bit_count() for x, y in zip(prints[i], prints[i + 1])) for i in range(0, len(texts), 2)]
    assert max(apart) <= simhash.RADIUS


def test_set_groups(spark):
    rng = random.Random(2)
    for most in (1 << 20, 30):  # in one task, and by cores
        groups, want = [], set()
        for k in range(12):
            base = [rng.sample(range(1000 * b, 1000 * b + 70), 20) for b in range(2)]
            sets = []
            for _ in range(rng.choice([2, 3, 5, 12, 30])):
                s = list(rng.choice(base))
                for _ in range(rng.choice([0, 1, 2, 3, 6])):
                    s[rng.randrange(20)] = rng.choice([rng.randrange(1 << 32), rng.randrange(70)])
                sets.append(frozenset(s))
            names = [k * 1000 + i for i in range(len(sets))]
            near = [(names[i], names[j]) for i, j in itertools.combinations(range(len(sets)), 2) if similar(sets[i], sets[j])]
            part = parts_of(names, near)
            want |= {frozenset(n for n in names if part[n] == r) for r in part.values()}
            groups += [(k, n, np.array(sorted(s), dtype="<u4").tobytes()) for n, s in zip(names, sets)]
        links = jaccard.linked_sets(spark.createDataFrame(groups, "key long, name long, items binary"), 0.8, most).collect()
        part = parts_of([g[1] for g in groups], [(r.a, r.b) for r in links])
        assert {frozenset(n for n in part if part[n] == r) for r in part.values()} == want


def test_hmm(spark, docs, rows, nothing):
    got = sorted(hmm.scored(docs, states=2, rounds=2, head=20).collect(), key=lambda r: (key(r.doc_id), r.n_tokens))
    train = [split(lower(t or "")) for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    counts = defaultdict(int)
    for words in train:
        for w in [*words, ""]:
            counts[w] += 1
    total = sum(counts.values())
    want = sorted(rows, key=lambda r: (key(r[0]), len(split(r[1]))))
    assert len(got) == len(want)
    for g, (d, t) in zip(got, want):
        tokens = [*split(lower(t or "")), ""]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens)
        assert (g.doc_id, g.n_tokens, g.train_tokens) == (d, len(tokens), total)
        assert g.held_out == (zlib.crc32(str("" if d is None else d).encode()) % 7 == 2)
        assert g.n_known == sum(counts.get(w, 0) > 0 for w in tokens)
        assert g.base_score == pytest.approx(base) and math.isfinite(g.score) and g.score < 0
    assert hmm.scored(nothing, rounds=1).count() == 0


def test_forward_and_expected_counts():
    rng = np.random.default_rng(0)
    k, size = 3, 4

    def stochastic(*shape):
        x = rng.random(shape)
        return x / x.sum(axis=-1, keepdims=True)

    p = hmm.Parameters(stochastic(k), stochastic(k, k), stochastic(k, size))
    sequences = [rng.integers(0, size, n).astype("<u2") for n in (1, 4, 2, 5, 5)]
    likelihood, first, moves, emit = [], np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
    for s in sequences:
        weights = {}
        for path in itertools.product(range(k), repeat=len(s)):
            w = p.initial[path[0]] * math.prod(p.move[a, b] for a, b in itertools.pairwise(path))
            weights[path] = w * math.prod(p.emit[a, x] for a, x in zip(path, s))
        total = sum(weights.values())
        likelihood.append(math.log10(total))
        for path, w in weights.items():
            first[path[0]] += w / total
            for a, b in itertools.pairwise(path):
                moves[a, b] += w / total
            for a, x in zip(path, s):
                emit[a, x] += w / total
    sheaf = hmm._Sheaf(sequences)
    assert sheaf.log10(p) == pytest.approx(likelihood)
    got = sheaf.expected(p)
    for x, y in zip(got, (first, moves, emit, sum(likelihood))):
        assert x == pytest.approx(y)


def test_training_raises_the_likelihood(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("abcde" if i % 2 else "vwxyz") for _ in range(40))) for i in range(120)]
    docs = hmm.texts(spark.createDataFrame(texts, "doc_id long, text string"))
    words = hmm.lexicon(hmm.word_counts(docs))
    _, got = hmm.train(hmm.encoded(docs, words).select("row", "symbols"), words, states=2, rounds=5)
    assert all(a < b + 1e-6 for a, b in itertools.pairwise(got)) and got[-1] > got[0] + 100


def test_text_statistics(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = sorted(decision_list.judged(docs, labels).collect(), key=lambda r: (key(r.doc_id), r.n_words))
    for g, (d, t) in zip(got, sorted(rows, key=lambda r: (key(r[0]), len(split(r[1])))), strict=True):
        t = t or ""
        words, lines = split(t), [x for x in t.split("\n") if split(x)]
        seen = defaultdict(list)
        for i in range(len(words) - 7):
            seen[tuple(words[i : i + 8])].append(i)
        repeats = len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(words) < 20 or 100 * repeats > 30 * len(words))
        assert not (g.base_failed and g.kept)
    kept = decision_list.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(g.kept for g in got)
    assert decision_list.judged(nothing, labels).count() == 0
    assert decision_list.judged(docs, labels.where("1 = 0")).where("NOT kept AND NOT base_failed").count() == 0


def test_rules_separate_bad_texts(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(w + ("##" if i % 3 == 0 else "") for w in sentence(rng, 60).split())) for i in range(150)]
    texts += [(i, sentence(rng, 60, 6) if i % 2 else sentence(rng, 60)) for i in range(150, 300)]
    bad = {i for i, _ in texts if (i < 150 and i % 3 == 0) or (i >= 150 and i % 2)}
    labels = spark.createDataFrame([(i, int(i not in bad)) for i, _ in texts], "doc_id long, quality int")
    got = decision_list.judged(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    assert {r.doc_id for r in got.where("NOT kept").collect()} == bad


def test_suffix_array(docs, rows, nothing):
    got = {}
    for r in suffix_array.deduplicated(docs, with_text=True).collect():
        got.setdefault((key(r.doc_id), r.n_bytes), []).append((r.n_removed, r.n_spans, r.kept_sha256, r.kept))
    first, want = {}, {}
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        data = (t or "").encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], key(d))
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.setdefault((key(d), len(data)), []).append((sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    assert got == want
    assert suffix_array.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("often", [0, 3])
def test_suffix_array_deals_out_hot_anchors(docs, rows, nothing, often, monkeypatch):
    monkeypatch.setattr(suffix_array, "OFTEN", often)
    test_suffix_array(docs, rows, nothing)


def test_strings_of_a_hot_anchor_meet_in_many_buckets(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix_array, "OFTEN", 100)
    texts = [f"{rng.randrange(10**12):040} a frequent phrase {rng.randrange(10**12):040}" for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (400, texts[7])], "doc_id long, text string").repartition(4)
    chunks, size = suffix_array.written(docs, "hot_chunks")
    candidates, buckets, answers = suffix_array.repeats(chunks, size)
    assert any(r.hot for r in candidates.collect())
    sorted_in = {r.bucket for r in answers.collect()}
    assert sum(b >= 3 * buckets for b in sorted_in) > 3
    removed = {r.doc_id: r.n_removed for r in suffix_array.deduplicated(docs).collect()}
    assert removed[400] == len(texts[7]) and removed[0] == 0


def test_blind_trie():
    rng = random.Random(0)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab") for _ in range(7)) for _ in range(rng.randint(1, 40))]
        classes = suffix_array.blind_trie(strings)
        assert [strings[c[0]] for c in classes] == sorted(set(strings))
        assert all(len({strings[i] for i in c}) == 1 for c in classes)
        assert sorted(itertools.chain(*classes)) == list(range(len(strings)))


def test_paragraphs(docs, rows, nothing):
    assert 1 - (1 - 0.8**2) ** paragraphs.bands() >= 0.99
    got = {}
    for r in paragraphs.deduplicated(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = dict(reversed(rows))
    for i in range(40, 46):  # exact copies of texts with at least 24 words go
        assert got[i][0].n_removed == (got[i][0].n_words if got[i][0].n_words >= 24 else 0)
    carriers = [i for i in range(46, 52)]
    passage = split(texts[46])[15:75]
    assert got[46][0].n_removed == 0
    for i in carriers[1:]:
        left = split(got[i][0].text)
        assert 46 in got[i][0].sources and 30 <= got[i][0].n_removed <= 64
        assert left[:12] == split(texts[i])[:12] and left[-6:] == split(texts[i])[-6:]
        assert " ".join(passage) not in " ".join(left)
    for i, t in enumerate(dict(rows[:40]).values()):
        assert got[i][0].n_removed == 0 and got[i][0].text == t
    assert [r.text for r in got[52 + 10]] == [""]
    whole = paragraphs.without_repeats(docs)
    assert whole.columns == docs.columns and whole.count() == len(rows)
    changed = {r.doc_id: r.text for r in whole.collect()}
    assert changed[47] == got[47][0].text and changed[0] == texts[0] and changed[62] is None
    assert paragraphs.deduplicated(nothing).count() == 0 and paragraphs.without_repeats(nothing).count() == 0


def slowly_removed(rows):
    """Which words of each row go: windows as strings, all pairs compared, components, matches followed word by word."""
    from keyloom.llm.chunks import Chunk

    units = []  # row, begin, size, shingles
    words = [split(lower(t or "")) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        data = (t or "").encode()
        w = paragraphs.Windows(Chunk(np.array([i]), np.array([0, len(data)]), data))
        for at, size in zip(w.at.tolist(), w.size.tolist()):
            units.append((k, at, size, frozenset(tuple(words[k][j : j + 5]) for j in range(at, at + size - 4))))
    sets = sorted({u[3] for u in units}, key=sorted)
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b):
            parent[find(a)] = find(b)
    place = {k: i for k, (i, _) in enumerate(rows)}
    least, first = {}, {}
    for u in units:
        for table, key in ((least, u[3]), (first, find(u[3]))):
            if key not in table or place[u[0]] < place[table[key][0]]:
                table[key] = u
    gone = [[False] * len(w) for w in words]
    hit = [u for u in units if place[first[find(u[3])][0]] < place[u[0]]]
    for k, at, size, _ in hit:
        gone[k][at : at + size] = [True] * size
    for k, at, size, s in hit:
        other = least[s] if place[least[s][0]] < place[k] else first[find(s)]
        mine, theirs = words[k], words[other[0]]
        ends = at + size, other[1] + other[2]
        for d in range(1, 16):
            if min(at, other[1]) < d or mine[at - d] != theirs[other[1] - d]:
                break
            gone[k][at - d] = True
        for d in range(15):
            if ends[0] + d >= len(mine) or ends[1] + d >= len(theirs) or mine[ends[0] + d] != theirs[ends[1] + d]:
                break
            gone[k][ends[0] + d] = True
    return gone


def test_tables_of_sets_are_removed_when_they_are_linked(spark, monkeypatch):
    written = []
    whole = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: written.append((name, whole(df, name))) or written[-1][1])
    items = lambda *n: np.array(n, dtype="<u4").tobytes()
    rows = [(1, 1, items(1, 2, 3, 4, 5)), (1, 2, items(1, 2, 3, 4, 5)), (1, 3, items(9,)), (2, 4, items(7,))]
    links = jaccard.linked_sets(spark.createDataFrame(rows, "key long, name long, items binary"), 0.8)
    assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset((1, 2))}
    folders = {name: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for name, df in written}
    assert not os.path.exists(folders["sets"]) and os.path.exists(folders["links"])


def test_words_are_hashed_eight_bytes_at_a_step():
    """A word's hash depends on its bytes alone, whatever its length and the part of the chunk that it stands in."""
    from keyloom.llm.chunks import Chunk

    words = [b"", b"a", b"Ab", b"\0", b"\0a\0", b"1234567", b"12345678", b"123456789", b"x" * 63, b"y" * 64, b"z" * 65, b"Q" * 300]
    texts = [b" ".join(words[i:] + words[:i]) for i in range(len(words))] * 200
    ends = np.cumsum([0] + [len(t) for t in texts])
    assert ends[-1] > paragraphs._BLOCK * 4  # several parts
    w = paragraphs.Windows(Chunk(np.arange(len(texts)), ends, b"".join(texts)))
    power = [pow(0x5851F42D4C957F2D, i, 1 << 64) for i in range(300)]
    values = [int(v) for v in paragraphs._BYTE]
    expected = {
        t: int(paragraphs._mix(np.array([sum(values[c] * power[i] for i, c in enumerate(t)) % (1 << 64)], dtype=np.uint64))[0])
        for t in words if t
    }
    data = b"".join(texts)
    got = [(data[a:b], h) for a, b, h in zip(w.start.tolist(), w.end.tolist(), w.word.tolist())]
    assert [t for t, _ in got] == [x for t in texts for x in t.split()] and all(h == expected[t] for t, h in got)
    alone = [paragraphs.Windows(Chunk(np.array([i]), np.array([0, len(t)]), t)) for i, t in enumerate(texts[:20])]
    assert np.array_equal(np.concatenate([x.word for x in alone]), w.word[: w.first[20]])


def test_paragraphs_against_brute_force(spark):
    rng = random.Random(11)
    rows, inside = [], {}
    for length in (39, 40, 45, 51, 60, 75, 100, 140):
        passage = sentence(rng, length, 5000)
        for _ in range(4):
            n = rng.randrange(0, 70)
            inside[len(rows)] = (n, length, len(rows) % 4)
            rows.append((len(rows), f"{sentence(rng, n, 5000)} {passage.upper() if rng.random() < 0.3 else passage}\n{sentence(rng, rng.randrange(50), 5000)}"))
    short = sentence(rng, 20, 5000)
    changed = split(rows[28][1])
    changed[len(changed) // 2] = "other"
    rows += [(32, short), (33, short.replace(" ", "\n")), (34, "a b c d"), (35, "a b c d"), (36, " ".join(changed)), (37, None), (38, "")]
    got = {r.doc_id: r for r in paragraphs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (i, text), gone in zip(rows, slowly_removed(rows)):
        assert got[i].n_removed == sum(gone) and got[i].n_words == len(gone)
        assert split(got[i].text) == [w for w, g in zip(split(text), gone) if not g]
        assert got[i].n_spans == sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
    for i, (before, length, copy) in inside.items():  # later copies go whole, first ones stay, other words but a few stay
        assert got[i].n_removed == 0 if copy == 0 else length <= got[i].n_removed <= length + 8
    assert [got[i].n_removed for i in (32, 33, 34, 35)] == [0, 20, 0, 0]


def test_top_k(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(160)]
    vectors += [(160, vectors[0][1]), (161, vectors[0][1]), (200, None), (201, [None] * 12), (202, [math.inf] * 12), (203, [])]
    vectors += [(250, [1.0, 2.0]), (251, [0.5, -1.0]), (300, [float("nan")] * 12), (0, [0.1] * 12), (None, [0.2] * 12)]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    found = topk.integers(table, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(found.where("id % 50 = 0"), found, 5).collect())
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    best = defaultdict(list)
    for q, v in clean:
        if q % 50 == 0:
            best[q] += [(-sum(a * b for a, b in zip(v, w)), x) for x, w in clean if x != q and len(w) == len(v)]
    want = sorted((q, n, x, -s) for q, all_ in best.items() for n, (s, x) in enumerate(sorted(all_)[:5], 1))
    assert got == want
    assert topk.top_k(found.where("1 = 0"), found, 5).count() == 0


def test_html(spark):
    good = "the cat sat on the mat and it was good for him to be in the house "
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><nav><a href=x>Home</a> <a>News</a></nav>
    <div class="cookie-notice">We use the cookies of the site</div><article><h1>Big &amp; small</h1><p>{good * 2}<br>more</p>
    <p>Ok.<div class=ad>Buy the best of all</div><form><p>Name</form><section class="comments"><p>{good * 2}</section></article>
    <aside>{good * 3}</aside><script>if (a < b) "</p>"</script><footer>&copy; 2020</footer></body>"""
    plain = f"<div id=c><h2>Head</h2><p>{good * 2}<p>a &lt; b</div><div>Copyright</div>"
    rows = [(1, "u", page, "x"), (2, None, plain, "x"), (3, "u", None, "x"), (4, "u", "", "x"), (None, "u", "<p", "x"), (1, "u", page, "x")]
    rows.append((5, "u", f"<article><p>{good * 20000}</article>", "x"))
    got = html_blocks.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[1] == f"Big & small\n\n{(good * 2).strip()} more\n\nOk."
    assert text[2] == f"Head\n\n{(good * 2).strip()}\n\na < b"
    assert text[3] == text[4] == "" and text[5] == (good * 20000).strip()


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], dtype="<u4")
            want.append((key(d), n, a, len(part), zlib.crc32(part.tobytes())))
    got = packing.packed(docs, WORD_BPE).collect()
    assert sorted((key(r.doc_id), *r[1:5]) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed(nothing, WORD_BPE).count() == 0


def test_words_are_encoded_as_in_the_text():
    from tokenizers import Tokenizer

    texts = ["It's a | b|c || x", "ΟΔΟΣ é ́x\x1c4 5  z", "<|endoftext|> a<|startoftext|>b", "", "A" * 300]
    for t, got in zip(texts, packing.encode(WORD_BPE, [t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(WORD_BPE).encode(t, add_special_tokens=False).ids


def test_fullest_bin():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 8))}
        capacity = max(40, max(counts))
        chosen = packing.fullest(dict(counts), capacity)
        sums = {max(counts)}
        left = [x for x, n in counts.items() for _ in range(n - (x == max(counts)))]
        for x in left:
            sums |= {s + x for s in sums if s + x <= capacity}
        assert sum(x * n for x, n in chosen.items()) == max(sums)
        assert all(n <= counts[x] for x, n in chosen.items())
        used = defaultdict(int)
        for bins, each in packing.plan(counts, capacity):
            for x, n in each.items():
                used[x] += bins * n
        assert used == counts


def test_chat(spark):
    turns = [
        (1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hey\nyou"), (1, 3, "ann", None), (2, None, None, "é"),
        (2, 300, "x", "late"), (2, 0, "x", ""), (2, 0, "x", ""), (None, 0, "y", "z"), (3, 0, "system", "alone"),
    ]
    got = chat.rotated(spark.createDataFrame([(*t, "?") for t in turns], "conv_id long, turn long, role string, text string, part string"))
    seen = {}
    for r in got.collect():
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",") if s]
        assert r.n_masked == sum(b - a for a, b in spans)
        seen[r.conv_id, r.perspective, r.part] = r.text, [r.text[a:b] for a, b in spans]
    s, e = "<|im_start|>", "<|im_end|>"
    assert seen[1, "ann", 0] == (
        f"{s}system\nBe kind{e}\n{s}assistant\nHi{e}\n{s}user name=bob\nHey\nyou{e}\n{s}assistant\n{e}\n", [f"Hi{e}", e]
    )
    assert seen[1, "bob", 0][1] == [f"Hey\nyou{e}"]
    assert seen[2, "x", 0][0] == f"{s}assistant\n{e}\n" * 2 and seen[2, "x", 1][1] == [f"late{e}"]
    assert seen[2, "unknown", 1 << 53] == (f"{s}assistant\né{e}\n", [f"é{e}"])
    assert (None, "y", 0) in seen and not any(k[0] == 3 for k in seen)
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_deals_out_ties(spark):
    turns = [(1, 5, "a" if i % 2 else "b", f"t{i:05}") for i in range(3000)]
    got = chat.rotated(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len({r.sub for r in got}) == 3 and sum(r.n_turns for r in got) == 6000
    assert all(r.n_turns < 1500 for r in got)


def test_chat_keeps_large_parts_in_order(spark):
    rng = random.Random(6)
    turns = [(1, rng.choice([3, 7]), rng.choice("ab"), f"t{rng.randrange(500):03}") for _ in range(2500)] + [(1, 5, "a", "again")] * 2600
    turns += [(None, None, rng.choice("ab"), f"u{rng.randrange(10**6)}") for _ in range(1500)] + [(2, 1, "a", "short"), (1, 300, "b", "next")]
    rng.shuffle(turns)
    got = chat.rotated(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    for conv, perspective in ((1, "a"), (1, "b"), (None, "a"), (2, "a")):
        own = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, perspective)), key=lambda r: (r.part, r.sub))
        said = sorted((t[1:] for t in turns if t[0] == conv), key=lambda t: (t[0] is None, t[0] or 0, *t[1:]))
        role = lambda s: "assistant" if s == perspective else f"user name={s}"
        assert "".join(r.text for r in own) == "".join(f"<|im_start|>{role(s)}\n{t}<|im_end|>\n" for _, s, t in said)
        masked = [r.text[int(a) : int(b)] for r in own for a, b in (m.split("-") for m in r.mask.split(",") if m)]
        assert masked == [f"{t}<|im_end|>" for _, s, t in said if s == perspective]
        assert max(r.n_turns for r in own) <= chat.PART_ROWS


def test_viterbi_is_the_best_segmentation():
    model = pieces.load(PIECES)
    scores = {p: (s, i) for i, (p, s) in enumerate(zip(model.pieces, model.scores))}
    rng = random.Random(8)
    for _ in range(150):
        text = pieces.SPACE + "".join(rng.choice("thean de▁é中\nx0") for _ in range(rng.randint(1, 14)))
        best = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = best[end - 1] + model.unknown_score
            for start in range(max(0, end - 20), end):
                piece = text[start:end]
                if piece in scores and not re.fullmatch(r"<.*>", piece):
                    best[end] = max(best[end], best[start] + scores[piece][0])
        path, score = pieces.viterbi(model, text)
        assert score == pytest.approx(best[-1])
        assert "".join(text[a:b] for _, a, b in path) == text


def test_pieces_round_trip(docs, rows, nothing):
    encoded = pieces.encode(docs, PIECES)
    back = sorted(((key(r.doc_id), r.text) for r in pieces.decode(encoded, PIECES).collect()))
    assert back == sorted((key(d), t or "") for d, t in rows)
    got = pieces.encoded_digest(docs, PIECES).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    ids = {(key(r.doc_id), len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in encoded.collect()}
    assert ids == {(key(r.doc_id), r.n_ids, r.ids_crc32) for r in got}
    assert pieces.encode(nothing, PIECES).count() == 0


def test_words_are_segmented_like_the_whole_text():
    model = pieces.load(PIECES)
    for text in ("  two  spaces ", "a b\nc d", "été ▁ x", " ", "<unk> <s>"):
        assert pieces.encode_text(model, text)[::2] == pieces._ids(model, pieces.SPACE + text.replace(" ", pieces.SPACE))[::2]


def test_word_ids_equal_those_of_whole_texts(rows):
    """Plain words are cut here; ids are those of the whole tokenizer for any text, special tokens' names included."""
    from tokenizers import Tokenizer

    odd = ["O'Neil's DON'T it's 'S 're'LL", "é É ÀÇß ÿŸ Ω İ ſ K áé", "x|y | || a|", "4.5,6 $%^ a<|endoftext|>b <|startoftext|>",
           "日本語 テスト nb ab\u0085cd \U0001f600", "ªº²³¹½ µ× ÷ð", "", " \t", "AKIA9__-x=/+", "a" * 3000]
    texts = [t or "" for _, t in rows] + odd
    whole = Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)
    got = packing.encode(WORD_BPE, [t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in whole]


@pytest.mark.parametrize("unit", ["<a ", "</a ", '<p x="', "<p x='>\"", '<a ">"', "<!--", "<script ", "<div><b>", "</p><section>", "&amp", "<p>"])
def test_hostile_pages_take_linear_time(unit):
    for page in (unit * 100_000, f"<p>{unit * 100_000}</p>", f"{'<div>' * 50_000}{unit * 50_000}", unit * 50_000 + "'>"):
        start = time.process_time()
        html_blocks.main_text(page)
        assert time.process_time() - start < 10


def test_hint_words_among_others_do_not_veto(spark):
    good = "the cat sat on the mat and it was good for him to be in the house"
    for name in ("social-history", "ad-hoc-notes", "related-work", "form-factor"):
        assert html_blocks.main_text(f'<main><div class="{name}"><p>{good}, and so it was for all of us</p></div></main>').startswith(good)
        assert html_blocks.main_text(f'<div class="x {name}"><p>{good}, and so it was for all of us</p><p>Share</p></div>').startswith(good)
    for name in ("ad", "site-footer", "cookie-notice", "x comment", "newsletter_box", "share-buttons"):
        assert html_blocks.main_text(f'<main><p>{good}, all of them.</p><div class="{name}"><p>{good}, buy it now</p></div></main>').endswith("them.")
    assert html_blocks.main_text("<p>text</p><!-- a > b") == html_blocks.main_text("<p>text</p><script>if (a > b) c") == ""
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_blocks.extracted(nothing).count() == 0


def test_top_k_of_large_components(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.choice([2.0**20, -(2.0**21), 2.0**40 + 0.3, 1e300, 0.1, -3.7]) * rng.random() for _ in range(6)]) for i in range(120)]
    vectors += [(i, [2.0**31 - 1 + i % 3] * 6) for i in range(120, 130)] + [(i, [0.3] * 6) for i in range(130, 160)] + [(200, [1.7e308] * 6)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = topk.integers(table, "vec_id", "embedding")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(found.where("id % 50 = 0"), found, 5).collect()}
    whole = {i: [math.floor(x * 256) if abs(x) < 2.0**900 else int(x) * 256 for x in v] for i, v in vectors}
    limit = 2**63 - 1
    want = {}
    for q in (0, 50, 100, 150, 200):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), x) for x, v in whole.items() if x != q)[:5]
        want |= {(q, n): (x, max(-limit, min(limit, -s))) for n, (s, x) in enumerate(best, 1)}
    assert got == want


def test_unrelated_texts_with_one_id_stay(spark):
    rng = random.Random(13)
    a, b, c = (sentence(rng, 60, 10**6) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (2, c, "z"), (3, a, "copy"), (1, a, "x")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, digest string"))
    assert sorted(map(tuple, kept.collect())) == sorted({(1, a, "x"), (1, b, "y"), (2, c, "z")})


def test_chat_sql_cuts_large_parts_as_the_operator(spark):
    import duckdb

    from keyloom.llm import queries

    turns = [(1, i % 7, f"r{i % 3}" if i % 5 else None, f"t{i % 600}") for i in range(2600)] + [(2, 300, "system", "s"), (2, None, "u", None)]
    columns = ["conv_id", "turn", "role", "text"]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.rotated(frame).select("conv_id", "perspective", "part", "sub", "n_turns", "n_masked", "mask", "text").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany(f"INSERT INTO conversations ({', '.join(columns)}) VALUES (?, ?, ?, ?)", turns)
    want = con.execute(queries.CHAT_SQL).fetchall()
    assert len(got) == len(want) > 4 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
