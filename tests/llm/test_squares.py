"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from cubeloom.llm import squares

from .conftest import CLASH


def runs_by_hand(s, least=12):
    """Every maximal stretch with s[x] == s[x + q], for each q; of equal stretches the smallest q."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        x = 0
        while x + q < len(s):
            y = x
            while y + q < len(s) and s[y] == s[y + q]:
                y += 1
            if y > x and y + q - x >= max(least, 2 * q):
                found.setdefault((x, y + q), q)
            x = y + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, kinds = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5])
    s = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    return s


@pytest.mark.parametrize("least", [2, 5, 12, 20])
def test_every_run_is_caught_however_the_words_are_appended(least):
    rng = random.Random(least)
    for _ in range(150):
        s = periodic_words(rng)
        want = runs_by_hand(s, least)
        for step in (None, 1, rng.randint(2, 40)):
            assert squares.find_runs(s, least, step) == want, (s, step)


def test_texts_of_one_stream_do_not_touch():
    rng = random.Random(3)
    for _ in range(60):
        texts = [periodic_words(rng) for _ in range(6)]
        texts.append(texts[0])
        got = squares.group_runs([[b"%d" % x for x in t] for t in texts], 12)
        assert got == [runs_by_hand(t) for t in texts]


@pytest.mark.parametrize("s", [[0] * 5000, [i % 7 for i in range(5000)], [bin(i).count("1") % 2 for i in range(2000)]])
def test_long_regular_texts(s):
    got = squares.find_runs(s)
    if len(s) == 5000:
        assert got == [(0, 5000, s[:8].index(max(s)) + 1)]
    else:
        assert got == runs_by_hand(s)


def expected(doc_id, text):
    """The columns of op13 by the contract's words."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [r for r in docs.collect() if r["text"] is None or len(r["text"]) < 2500]
    more = [(10**6 + i, " ".join(f"w{x}" for x in periodic_words(random.Random(i)))) for i in range(40)]
    monkeypatch.setattr(squares, "table", lambda *_: spark.createDataFrame([tuple(r) for r in rows] + more, "doc_id long, text string"))
    got = sorted(tuple(r) for r in squares.op13_squares(spark, "").collect())
    assert got == sorted(expected(i, t) for i, t in [tuple(r) for r in rows] + more)
    assert sum(r[1] > 0 for r in got) > 20


def test_odd_rows(spark, edge_docs, no_docs):
    got = squares.periodic_runs(edge_docs)
    assert got.columns == ["doc_id", "words", "runs", "collapsed"] and got.count() == edge_docs.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["words"] == rows[2]["words"] == rows[3]["words"] == 0 and rows[1]["runs"] == [] and rows[3]["collapsed"] == ""
    assert rows[5]["words"] == 40_000 and rows[5]["runs"] == [(0, 40_000, 977 * 31)] * (2 * 977 * 31 <= 40_000)
    assert squares.periodic_runs(no_docs).count() == 0
    digest = squares.periodic_runs(edge_docs, prepare=squares.repeated_tail, digest=True)
    assert set(CLASH).isdisjoint(digest.columns)
    short = [(r["doc_id"], r["text"]) for r in edge_docs.collect() if len(r["text"] or "") < 1000]
    got = [tuple(r) for r in digest.collect() if r["doc_id"] not in (5, 6, 11)]
    assert sorted(map(str, got)) == sorted(str(expected(*r)) for r in short)
