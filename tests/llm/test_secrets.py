"""Secret scan against Python's own regular expressions and models, and on odd texts."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest

from keyloom.llm import secrets

KINDS = ("assign", "access", "hex", "random")
BASE = [
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+",
]
COLUMNS = "doc_id long, text string, base string, spans string, names string, start int"


def base_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.compile(pattern, re.ASCII).finditer(text or ""):
            if len(m[2] if kind == 0 else m[0]) >= (6, 20, 24)[kind]:
                out.append((m.start(), kind, m.end(), m[0]))
    return sorted(out)


def symbols(text):
    return [secrets.SYMBOLS.index(c) for c in text.lower() if c in secrets.SYMBOLS]


def ratio(text, models):
    before, total = secrets.START, 0.0
    for s in symbols(text):
        total += models.ratios[before * len(secrets.SYMBOLS) + s]
        before = s
    return total


def brute(rows):
    """Spans of every row, by both models counted anew from the rows."""
    found = [base_spans(t) for _, t in rows]
    value = lambda s: re.match(BASE[0], s[3], re.ASCII)[2] if s[1] == 0 else s[3]
    positive = {value(s) for spans in found for s in spans}
    names = set()
    for _, text in rows:
        plain = re.sub(BASE[0], " ", text or "", flags=re.ASCII)
        plain = re.sub(r"[0-9a-f]{24,}", " ", re.sub(r"AKIA[A-Z0-9]{16,}", " ", plain))
        names |= set(re.findall(r"[A-Za-z0-9+/_=-]{8,}", plain))
    width, counts = len(secrets.SYMBOLS), {}
    for label, texts in ((True, positive), (False, names)):
        counts[label] = Counter()
        for t in texts:
            s = symbols(t)
            counts[label].update(a * width + b for a, b in zip([secrets.START, *s], s))
    ratios = []
    for before in range(width + 1):
        sums = {k: sum(counts[k][before * width + i] for i in range(width)) for k in counts}
        for i in range(width):
            p, q = ((counts[k][before * width + i] + 1) / (sums[k] + width) for k in (True, False))
            ratios.append(math.log(0.5 * p + 0.5 / width) - math.log(q))
    least = max(0.0, math.log((len(names) + 1) / (len(positive) + 1))) + math.log(0.999 / 0.001)
    models = secrets.Models(tuple(ratios), least)
    out = []
    for (doc_id, text), base in zip(rows, found):
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text or ""):
            apart = all(m.end() <= b[0] or b[2] <= m.start() for b in base)
            if apart and ratio(m[0], models) > models.least:
                more.append((m.start(), 3, m.end(), m[0]))
        out.append((doc_id, base, sorted(base + more)))
    return out


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    token = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    syllables = ["er", "tion", "the", "ing", "ment", "ation", "under", "stand", "ous", "able", "con", "pro", "_", "get"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = [(i, prose(80)) for i in range(60)]
    out += [(i, f'{prose(9)} Token = "{token(40, "0123456789abcdef")}" É {prose(9)}') for i in range(60, 90)]
    out += [(i, f"{prose(5)} {token(32, string.ascii_letters + string.digits)} {prose(5)}") for i in range(90, 100)]
    out += [(100, f"AKIA{token(16, string.ascii_uppercase)} AKIA12 {token(24, '0123456789abcdef')}{token(30, 'abcdef')}"), (101, None)]
    out += [(102, ""), (103, "secret: token: abcdef password=a passwd='hunter22' api_key:\t no apikey = 'x.y-z_=/+1'"), (None, "secret=aaaaaa")]
    out += [(104, "é\U0001F600 token=token=abcdefgh ſecret=abcdefgh toKen=abcdefgh"), (105, f"x {token(40, '0123456789ABCDEF')}")]
    out += [(106, " ".join(token(20, "0123456789abcdef") + token(6, "0123456789") for _ in range(3000))), out[60], out[90]]
    return out


def test_secret_spans(spark, rows):
    docs = spark.createDataFrame([(i, t, "?", "?", "?", 1) for i, t in rows], COLUMNS).repartition(4)
    got = secrets.secret_digest(docs).collect()
    want = []
    for doc_id, base, spans in brute(rows):
        n = Counter(s[1] for s in base)
        want.append((doc_id, n[0], n[1], n[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    by_id = {r["doc_id"]: r["spans"] for r in got}
    assert all("random" in by_id[i] for i in (*range(90, 100), 105))  # strings that no pattern names
    assert not any("random" in by_id[i] for i in range(60))


def test_span_texts(spark, rows):
    docs = spark.createDataFrame([(i, t, "?", "?", "?", 1) for i, t in rows], COLUMNS)
    texts = dict(rows)
    for r in secrets.found_secrets(docs).collect():
        assert all((texts[r["doc_id"]] or "")[s["start"] : s["stop"]] == s["text"] for s in r["spans"])


def test_given_samples_and_empty_tables(spark, rows):
    docs = spark.createDataFrame([(1, "zzqqzzqqzzqqzzqqzz ordinaryordinary", "?", "?", "?", 1)], COLUMNS)
    samples = [("zzqqzzqqzzqqzzqqzz", True), ("qqzzqqzz", True), ("ordinaryordinary", False), (None, True), ("x", None)]
    labelled = spark.createDataFrame(samples, "text string, random boolean")
    assert [s["text"] for s in secrets.found_secrets(docs, labelled).head()["spans"]] == ["zzqqzzqqzzqqzzqqzz"]
    assert secrets.secret_digest(docs.where("1 = 0")).count() == 0
    assert [s["text"] for s in secrets.found_secrets(docs, labelled.where("1 = 0")).head()["spans"]] == []
