"""Decontamination, hard negatives and periodic runs against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from duelkit.llm import decontamination, negatives, periods
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _words(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]


def _windows(texts, window=10):
    for text in texts:
        w = [x[0] for x in _words(text)]
        for i in range(max(len(w) - window + 1, min(len(w), 1))):
            yield tuple(w[i : i + window])


def contaminated(text, items, window=10):
    """Hit places, and names of the items found."""
    w = _words(text)
    hit, names = set(), set()
    for name, texts in items:
        for win in set(_windows(texts, window)):
            for i in range(len(w) - len(win) + 1):
                if tuple(x[0] for x in w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    names.add("" if name is None else str(name))
    return w, hit, sorted(names, key=str.encode)


ITEMS = [(1, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, "short one"), (3, None), (4, ""), (None, "nameless item here"), (5, "Über straße 42"), (10, "short one"), (1, "more words of the same item than ten are in this text, it is long")]
LONG = "Alpha, beta; gamma.\nDELTA epsilon-zeta eta theta iota kappa"
DOCS = [
    (1, LONG), (2, "x " + LONG + " lambda mu nu " + LONG), (3, None), (4, ""), (5, "a short one and a SHORT ONE!"), (6, "shortone"), (7, "ü ÜBER straße Über straße 42"), (8, "nameless item here" * 2 + " nameless item here"),
    (None, "no id short one"), (9, LONG + " lambda" + " filler" * 5000 + " short one"), (1, LONG), (11, " ".join(LONG.split()[:8])),
]


@pytest.mark.parametrize("part_words", [decontamination.PART_WORDS, 7])
def test_decontamination_is_plain_search(spark, part_words):
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("spans", F.lit("x"))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"row": F.lit(1), "items": F.lit(2), "n_hit": F.lit(3)})
    got = decontamination.decontaminate(docs, items, part_words=part_words).collect()
    texts = {}
    for doc, text in DOCS:
        texts.setdefault(doc, text)
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (d for d, _ in DOCS)))
    for r in got:
        text = texts[r["doc_id"]]
        w, hit, names = contaminated(text, [(n, [t]) for n, t in ITEMS])
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), names, bool(hit))
        covered = set()
        for s in r["spans"]:
            places = range(s["word"], s["word"] + s["words"])
            covered.update(places)
            assert (s["start"], s["end"]) == (w[places[0]][1], w[places[-1]][2])
            assert places[0] - 1 not in hit and places[-1] + 1 not in hit
        assert covered == hit


def test_decontamination_reads_questions_and_answers_apart(spark):
    items = spark.createDataFrame([(1, "one two three", "four five")], "item_id int, question string, answer string")
    docs = spark.createDataFrame([(1, "one two three four"), (2, "three four five"), (3, "two three four")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontamination.decontaminate(docs, items, item_texts=("question", "answer")).collect()}
    assert got == {1: 3, 2: 2, 3: 0}


def test_decontamination_of_nothing(spark):
    items, docs = spark.createDataFrame(ITEMS, "item_id int, text string"), spark.createDataFrame(DOCS, "doc_id long, text string")
    assert decontamination.contamination_digest(docs.limit(0), items).count() == 0
    none = decontamination.contamination_digest(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and {(r["n_hit"], r["n_items"], r["items_sha256"]) for r in none} == {(0, 0, hashlib.sha256(b"").hexdigest())}


def test_decontamination_of_the_table(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    items = [(r["item_id"], [r["text"]]) for r in read("benchmark").collect()]
    wanted: dict[tuple, set[str]] = {}
    for name, texts in items:
        for win in _windows(texts):
            wanted.setdefault(win, set()).add(str(name))
    texts = {r["doc_id"]: r["text"] for r in read("documents").collect()}
    found = 0
    for r in decontamination.contamination_digest(read("documents"), read("benchmark")).collect():
        w = [x[0] for x in _words(texts[r["doc_id"]])]
        hit, names = set(), set()
        for i in range(len(w) - 9):
            if (own := wanted.get(tuple(w[i : i + 10]))) is not None:
                hit.update(range(i, i + 10))
                names |= own
        found += bool(hit)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    assert found


# --- hard negatives


def hard(rows, scale=256):
    """(anchor, positive, rank, negative, positive score, negative score) by plain loops, rows in order of ids."""
    ready = []
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ready.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(scale * x) for x in v]))
    key = lambda s, r: (-s, r[0] is None, r[0] or 0)
    out = []
    for a in ready:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in ready if b is not a]  # noqa: B905
        same = sorted((x for x in scored if x[1][1] == a[1]), key=lambda x: key(*x))[:5]
        for ps, p in same:
            ok = sorted((x for x in scored if x[1][1] != a[1] and 30 * ps <= 100 * x[0] <= 90 * ps), key=lambda x: key(*x))[:10]
            out += [(a[0], p[0], k, n[0], ps, s) for k, (s, n) in enumerate(ok, 1)]
    return sorted(out, key=str)


def _mined(spark, rows, kind="double"):
    rows = [(i, label, None if v is None else [None if x is None else float(x) for x in v]) for i, label, v in rows]
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumns({"row": F.lit(7), "angle": F.lit(1), "query": F.lit(True)})
    return sorted(map(tuple, negatives.hard_negatives(df).collect()), key=str)


@pytest.mark.parametrize("block", [7, 4096])
def test_hard_negatives_are_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "QUERIES", 3)
    rng = np.random.default_rng(3)
    near = rng.standard_normal(6)
    rows = [(i, int(rng.integers(0, 4)), (near + rng.standard_normal(6) * rng.choice([0.1, 1.0])).round(2).tolist()) for i in range(0, 700, 5)]
    rows += [(i, 1, [1.0, 0.5, 0, 0, 0, 0]) for i in range(1001, 1101)]  # many copies: ties
    rows += [(2000, 2, [0.0] * 6), (2001, 2, [0.0] * 6), (2100, 3, [-1.0] * 6)]
    rows += [(3000, None, [1.0] * 6), (3100, 1, None), (3200, 1, [float("nan")] + [1.0] * 5), (3201, 2, [float("inf")] + [1.0] * 5), (3202, 2, [None] + [1.0] * 5), (None, 2, [1.0] * 6), (3300, 1, []), (3301, 5, [2.0, 2.0])]
    want = hard(rows)
    assert want and _mined(spark, rows) == want


def test_hard_negatives_of_large_numbers_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.standard_normal(5) * 3e5).tolist()) for i in range(0, 200, 10)]  # sums beyond 2^53
    rows.append((400, 1, [1e300, 0, 0, 0, 0]))  # too long for 64 bits: takes no part
    want = hard(rows[:-1])
    assert max(x[4] for x in want) > 1 << 53
    assert _mined(spark, rows) == want


def test_hard_negatives_of_repeated_rows_and_nothing(spark):
    rows = [(100, 1, [1.0, 0.0])] * 2 + [(101, 2, [0.5, 0.0])] * 3
    got = _mined(spark, rows)
    assert got == sorted([(100, 100, k, 101, 65536, 32768) for k in (1, 2, 3)] * 2, key=str)
    assert _mined(spark, [(101, 2, [0.5])]) == [] and _mined(spark, [(100, 2, [0.5])]) == []
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_bounds_hold_scores(spark):
    rng = np.random.default_rng(8)
    refs = rng.standard_normal((16, 24))
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    v = np.round(np.concatenate([rng.standard_normal((200, 24)) * 100, refs * 300, -refs * 300, np.zeros((1, 24))]))
    norm, angle = negatives._angles(v, refs)
    side = (None, None, None, v, norm, angle.astype("<f4").astype(float))
    low, high = negatives._bounds(side, side)
    score = v @ v.T
    assert (low <= score).all() and (score <= high).all()
    assert (high[:, 200:216] < np.outer(norm, norm)[:, 200:216] * 0.99).any()


# --- periodic runs


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if len(x) >= max(6, 4 * q) and next(p for p in range(1, q + 1) if x[p:] == x[:-p]) == q:
                out.append((i, len(x), q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_are_plain_lag_scans():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        letters = int(rng.integers(1, 5))
        w = [b"%d" % x for x in rng.integers(0, letters, int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            unit, at = [b"%d" % x for x in rng.integers(0, letters + 2, int(rng.integers(0, 6)))], int(rng.integers(0, len(w) + 1))
            w[at:at] = unit * int(rng.integers(1, 9))
        assert periods.runs(w) == plain_runs(w)


def test_segments_hold_no_rare_word():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.5, 5000)
    found = periods.segments(ids)
    assert found and all(np.unique(ids[a:b], return_counts=True)[1].min() >= 4 for a, b in found)


def _digest(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_run_digest_is_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 6000").collect()]
    ten = [i for i in range(10_000, 12_000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]  # documents that repeat words
    more = [(i, " ".join(f"w{k % 50}" for k in range(n))) for n, i in enumerate(ten)]
    more += [(1, None), (2, ""), (3, " \n\t "), (None, "a b " * 20), (4, "x " * 50 + "y\x0bz " * 30 + "é " * 6), (4, "x " * 50), (5, "q r " * 9)]
    rows = small + more
    got = periods.run_digest(spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((_digest(*r) for r in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 20


def test_runs_of_very_long_texts(spark):
    one, other = ["a"] * 200_000, [f"w{i % 700}" for i in range(140_000)]
    rows = [(1, " ".join(one)), (2, " ".join(other)), (3, "long" * 500_000)]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, 200_000, 1)], 2: [(0, 140_000, 700)], 3: []}
    assert periods.run_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
