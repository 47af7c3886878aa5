"""The pipeline's stages on the smallest tables, and on documents with nulls and repeated rows."""

import os
import random
import re

import pytest

import corpus_pipeline
from cubeloom.llm import credentials, jaccard, mixing, quality, tokens
from cubeloom.llm.common import work_path

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_are_named_and_ordered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mixture", "packing"]


def test_quality_drops_what_the_classifier_rejects(spark, docs):
    kept = corpus_pipeline.quality(spark, docs, FOLDER)
    scores = {r["doc_id"]: r["keep"] for r in quality.classify(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    assert set(texts(kept)) == {i for i, keep in scores.items() if keep} and kept.columns == docs.columns


def test_one_document_of_each_group_stays(spark, docs):
    kept = corpus_pipeline.near_copies(spark, docs, FOLDER)
    groups = jaccard.similar_documents(docs).collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in groups})
    assert kept.columns == docs.columns


def brute_near_copies(texts):
    """doc_id of the smallest document that each one is linked with by 5-word shingles at 0.8."""
    sets = {}
    for i, text in texts.items():
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_near_copies_go_by_five_words_at_80_percent(spark):
    base = [f"word{i}" for i in range(500)]
    far, near = list(base), list(base)
    for k in range(12):
        far[20 + 40 * k] = f"far{k}"
    for k in range(11):  # 441 of 551 shingles of five words, 453 of 541 of four words
        near[20 + 40 * k] = f"near{k}"
    texts = {1: " ".join(base), 2: " ".join(near), 3: " ".join(far), 4: " ".join(f"a{i}" for i in range(8)), 5: " ".join(f"a{i}" for i in range(9)), 6: "b c d"}
    rng = random.Random(4)
    for i in range(7, 47):
        w = texts[rng.choice([1, 4, 5, 6, *range(7, i)])].split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"r{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, FOLDER).collect()}
    assert kept == set(brute_near_copies(texts).values()) and 2 not in kept and 3 in kept and 5 not in kept


def test_secrets_are_masked_in_place(spark, docs):
    before, after = texts(docs), texts(corpus_pipeline.secrets(spark, docs, FOLDER))
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert len(after[i]) == len(text)
        assert not [m for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", after[i])]
        assert not [m for m in credentials.ASSIGN.finditer(after[i]) if len(m.group(2)) >= 6]


def test_mixture_repeats_documents_whole(spark, docs):
    mixed = corpus_pipeline.mixture(spark, docs, FOLDER).collect()
    before = texts(docs)
    times = {}
    for r in mixed:
        assert r["text"] == before[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3


def test_mixture_rows_follow_shard_and_place(spark, docs):
    rows = mixing.mix(docs).select("doc_id", "shard", "place").collect()
    want = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["place"]))]
    stage = corpus_pipeline.mixture(spark, docs, FOLDER)
    path = work_path(spark, "mixture-test")
    stage.write.parquet(path)
    got = [r["doc_id"] for r in spark.read.parquet(path).coalesce(1).collect()]
    shards = {r["doc_id"]: r["shard"] for r in rows}
    assert len(set(shards.values())) > 1 or got == want
    assert sorted(got) == sorted(want) and got != [r["doc_id"] for r in docs.collect() for _ in range(want.count(r["doc_id"]))]


def test_the_whole_run(spark, docs):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert rows and max(ends.values()) <= 2048


def test_the_packed_rows_hold_the_tokens(spark, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    some = docs.orderBy("doc_id").limit(40)
    rows = corpus_pipeline.packing(spark, some, FOLDER).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before = texts(some)
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and len(found.get(r["doc_id"], [])) == r["start"]
        found[r["doc_id"]] = found.get(r["doc_id"], []) + ids
    assert found == {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in before.items()}


def test_stages_bear_odd_rows(spark, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
        assert stage(spark, plain, FOLDER).columns == plain.columns, name
        stage(spark, plain, FOLDER).collect()
        assert stage(spark, no_docs, FOLDER).count() == 0, name
    kept = corpus_pipeline.near_copies(spark, edge_docs.select("doc_id", "text", "lang", "source", "n_chars"), FOLDER).collect()
    ids = sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)
    assert ids == [1, 2, 3, 4, 5, 7, 9, 10, 11] and sum(r["doc_id"] is None for r in kept) == 2


def test_tasks_leave_no_words_in_their_worker():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")

    def task(batches):
        for text in batches:
            yield tokens.encoder(path, 10).ids([text])

    assert [len(found) for found in tokens.lean(task)(["one two", "three"])] == [1, 1]
    assert tokens.encoder.cache_info().currsize == 0
    stopped = tokens.lean(task)(["one two", "three"])
    next(stopped)
    stopped.close()
    assert tokens.encoder.cache_info().currsize == 0
