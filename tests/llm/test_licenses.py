"""Licence scans against brute force."""

import random
import re

import pytest

from cubeloom.llm import licenses

from .conftest import CLASH

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(text, templates, percent, window):
    """Phrases at every place, every window against every template."""
    words = WORD.findall(lower(text))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    matches = []
    for t, (_, notice) in enumerate(templates):
        want = set(WORD.findall(lower(notice)))
        for block in range(0, 2 * len(words) // window + 1):
            both = want & set(words[block * (window // 2) : block * (window // 2) + window])
            if 100 * len(both) >= percent * len(want):
                matches.append((block, t, len(both), len(both) / len(want)))
    starts = [s for s, _ in places]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(templates[t][0] for _, t, _, _ in matches)})
    score = 1.0 if places else max((m[3] for m in matches), default=0.0)
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score,
            sorted(m[:3] for m in matches))


def answers(df):
    return sorted((r["doc_id"], *tuple(r)[1:8], [tuple(m) for m in r["matches"]]) for r in df.collect())


@pytest.mark.parametrize("percent,window", [(85, 64), (60, 20), (100, 40)])
def test_join_finds_what_brute_force_finds(spark, percent, window):
    rng = random.Random(percent)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in WORD.findall(lower(t))}) + [f"other{i}" for i in range(60)]
    texts = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            _, notice = rng.choice(licenses.TEMPLATES)
            cut = [w for w in notice.split() if rng.random() > rng.choice([0, 0.1, 0.2])]
            at = rng.randint(0, len(words))
            words[at:at] = cut + rng.choice([[], ["MIT", "license"], ["cc", "by", "cc", "BY"]])
        texts.append((i, rng.choice([" ", "\n", ", ", " - "]).join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = answers(licenses.license_scan(df, percent=percent, window=window))
    want = sorted((i, *expected(t, licenses.TEMPLATES, percent, window)) for i, t in texts)
    assert got == want
    assert sum(len(w[-1]) > 0 for w in want) > 20


def test_query_on_the_documents_equals_brute_force(spark):
    df = licenses.op12_licenses(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = sorted((r["doc_id"], *expected(r["text"], licenses.TEMPLATES, licenses.PERCENT, licenses.WINDOW)[:-1]) for r in docs)
    assert sorted(tuple(r) for r in df.collect()) == want
    assert any(w[2] for w in want)


def test_words_and_phrases(spark):
    text = "GNU General\nPublic-LICENSE gnu gnu general public license É apache licenseé CC-BY cc by x MIT License"
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row)[1:6] == expected(text, licenses.TEMPLATES, 85, 64)[:5]
    assert row["base_labels"] == "cc-by,gpl,mit" and row["score"] == 1.0


def test_odd_rows(spark, edge_docs, no_docs):
    got = licenses.license_scan(edge_docs)
    assert (set(CLASH) & set(got.columns)) == {"score"}
    short = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = sorted(str((i, *expected(t, licenses.TEMPLATES, 85, 64))) for i, t in short)
    assert sorted(str((r["doc_id"], *tuple(r)[1:8], [tuple(m) for m in r["matches"]])) for r in got.collect()) == want
    assert licenses.license_scan(no_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(edge_docs, templates=[("x", "?!")])
