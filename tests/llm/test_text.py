"""Chat, secrets, mixing, quality and the Jaccard join against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.llm import chat, credentials, graph, jaccard, mixing, quality

from .conftest import CLASH


def test_chat_round_trip_and_mask(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "\\h\\b#<:\n</turn>\n### user: x", "中\U0001f600#"]
    turns = [(r, t) for t in odd for r in ("user", "assistant", None, "a: b</turn>")]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None)], f"conv_id long, turns array<{chat.TURN}>")
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(df)).withColumn("loss", chat.loss_text()).collect()}
    assert [(x["role"], x["text"]) for x in got[1]["turns_read"]] == [(r or "", t or "") for r, t in turns]
    assert got[1]["loss"] == "".join(t or "" for r, t in turns if r == "assistant")
    spans = [got[1]["formatted"][s["start"] : s["end"]] for s in got[1]["loss_spans"]]
    assert len(spans) == len(odd) and all("#" not in s and "<" not in s for s in spans)
    for i in (2, 3):
        assert got[i]["formatted"] == "" and got[i]["turns_read"] == []


def test_fingerprints_choose_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"content":null,"role":"assistant"}]}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"response":"b","prompt":"a"}', '{"instruction":"s","input":"a","output":"b"}', '{"other":1}', "not json", None,
    ]
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(records)], "conv_id long, record string, layout_ int")
    got = {r["conv_id"]: r for r in chat.canonical_turns(df).collect()}
    assert [got[i]["layout"] for i in range(7)] == ["messages", "from_value", "prompt", "instruction", None, None, None]
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "a"), ("assistant", "b")]
    assert [(t["role"], t["text"]) for t in got[3]["turns"]] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert got[0]["turns"][1]["text"] is None and got[6]["turns"] is None


def test_rows_become_records_and_come_back(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 2, "user", None), (2, 1, None, "x"), (3, 0, "system", "s"),
            (3, 1, "user", "u"), (3, 2, "assistant", "a"), (4, 0, "user", "same"), (4, 0, "user", "same"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.canonical_turns(chat.records_of_rows(df)).collect()}
    for i in (1, 2, 3, 4, None):
        mine = sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] or 0))
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [(r[2], r[3]) for r in mine]
    assert chat.records_of_rows(df.limit(0)).count() == 0


def test_secrets_edge_cases(edge_docs, no_docs):
    got = {r["doc_id"]: r for r in credentials.find_secrets(edge_docs).collect() if r["doc_id"] is not None}
    assert [(s["kind"], s["start"], s["end"]) for s in got[10]["base"]] == [("assign", 0, 25), ("access", 30, 50)]
    assert got[10]["n_access"] == 1 and got[1]["base"] == [] and got[11]["base"] == []
    assert credentials.find_secrets(edge_docs).count() == edge_docs.count()
    assert credentials.find_secrets(no_docs).count() == 0
    masked = {r["doc_id"]: r["text"] for r in credentials.mask_secrets(edge_docs).collect() if r["doc_id"] is not None}
    assert set(masked[10]) >= {"*"} and "AKIA" not in masked[10] and " and " in masked[10] and masked[1] is None and masked[11] == "x" * 50_000
    same = [c for c in edge_docs.columns if c != "text"]
    assert credentials.mask_secrets(edge_docs).columns == edge_docs.columns
    assert sorted(map(str, credentials.mask_secrets(edge_docs).select(same).collect())) == sorted(map(str, edge_docs.select(same).collect()))


@pytest.mark.parametrize("bare", ["aB3" * 14, "aB3x" * 22, "aB3_-" * 9, "aB3+/" * 30 + "=="])
def test_bare_keys_of_any_length_and_alphabet_are_linked_and_masked(spark, bare):
    text = f"AKIA{'A1' * 9} key {bare} end"
    df = spark.createDataFrame([(1, text), (2, f"key {bare} end")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in credentials.mask_secrets(df).collect()}
    assert got[1] == "*" * 22 + " key " + "*" * len(bare) + " end" and got[2] == f"key {bare} end"


def test_few_labels_are_enough():
    rng = np.random.default_rng(3)
    y = np.array([0.0] * 3 + [1.0] * 6)
    x = rng.normal(size=(9, quality.TEXT_FEATURES)) * 0.01 + y[:, None]
    page = rng.normal(size=(9, quality.PAGE_FEATURES))
    model = quality.cotrain(x, page, y, x[:0], page[:0])
    assert model.text is not None and model.page is not None
    assert quality.cotrain(x, page, np.ones(9), x[:0], page[:0]) == quality.Model(None, None)


def test_base_spans_are_leftmost_and_do_not_overlap(spark):
    text = 'Token: "abc" SECRET=abcdefg api-key:12345678 api_key : "zzzzzz" passwd=\'x.y=z-1\' AKIAAKIA12 AKIA' + "A1" * 9 + " " + "ab12" * 7
    row = credentials.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = [("assign", m.start(), m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted((s["kind"], s["start"], s["end"]) for s in row["base"]) == sorted(want)
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (3, 1, 1)


def test_weak_parts_are_reported_only_beside_their_complements(spark):
    bare = "aB3" * 12
    near, far = "x " * 20, "x " * 600
    texts = {
        1: f"key {bare} end", 2: f"AKIA{'A1' * 9} {near} {bare}", 3: f"AKIA{'A1' * 9} {far} {bare}", 4: f"https://h.example/p {near} {bare}",
        5: "https://h.example/p alone", 6: f"user: anna {near} password=abcdefgh", 7: f"s3://b/k {near} AKIA{'A1' * 9} {near} secret=abcdefgh",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: sorted(texts[r["doc_id"]][s["start"] : s["end"]] for s in r["linked"]) for r in credentials.find_secrets(df).collect()}
    assert got == {1: [], 2: [bare], 3: [], 4: [bare], 5: [], 6: ["user: anna"], 7: ["s3://b/k"]}


def test_targets_stop_at_the_cap_and_share_the_rest():
    got = mixing.capped_targets([100, 100, 100, 0], [1, 2, 3, 1], 300)
    assert np.allclose(got, [50, 100, 150, 0])
    got = mixing.capped_targets([10, 1000, 10], [3, 1, 3], 1020)
    assert np.allclose(got, [30, 960, 30])
    assert mixing.capped_targets([], [], 0) == []


def test_the_splitting_tree_deals_every_unit_once():
    quotas = np.array([13, 0, 7, 101])
    for shards in (1, 2, 5, 16):
        parts = [mixing.shard_quota(quotas, shards, s, 9) for s in range(shards)]
        for i, n in enumerate(quotas):
            units = [u for first, count in parts for u in range(first[i], first[i] + count[i])]
            assert sorted(units) == list(range(n))
        totals = [int(count.sum()) for _, count in parts]
        assert max(totals) - min(totals) <= shards.bit_length() + 1


def test_mixing_meets_its_targets(spark, edge_docs, no_docs):
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "small").otherwise(F.lit(None)).alias("source"),
    )
    plan = mixing.make_plan(docs, block_words=100, blocks_per_shard=4)
    rows = mixing.draw(docs, plan).collect()
    assert len(rows) == 900
    sums = {}
    for r in rows:
        assert len(r["draws"]) <= 3 and len({u["pass"] for u in r["draws"]}) == len(r["draws"])
        s = sums.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["_size"] * len(r["draws"])
        s[1] += r["_size"]
    total = sum(s[1] for s in sums.values())
    want = mixing.capped_targets([sums[k][1] for k in ("hot", "small", None)], [1, 2, 3], total)
    for k, t in zip(("hot", "small", None), want):
        assert sums[k][3] == sums[k][1] and abs(sums[k][2] - t) < 1e-6 and abs(sums[k][0] - t) <= 13
    mixed = mixing.mix(docs, block_words=100, blocks_per_shard=4)
    again = mixing.mix(docs.repartition(7), block_words=100, blocks_per_shard=4)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    assert mixed.groupBy("shard").agg(F.max("place").alias("m"), F.count("*").alias("n")).filter("m <> n").isEmpty()
    assert mixing.mix(no_docs).count() == 0
    every = mixing.mix(edge_docs)
    assert every.columns == [*edge_docs.columns, "_shard", "_place"] and every.count() > 0
    assert every.select(*CLASH).distinct().collect() == edge_docs.select(*CLASH).distinct().collect()
    plain = edge_docs.drop(*CLASH)
    assert mixing.draw(plain, mixing.make_plan(plain)).count() == edge_docs.count()


def test_mixed_rows_are_made_dealt_and_counted(spark, edge_docs):
    docs = spark.range(600).select(
        F.when(F.col("id") % 50 > 0, F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "small").otherwise(F.lit(None)).alias("source"),
    )
    docs = docs.unionByName(docs.filter("doc_id % 7 = 0"))  # repeated rows
    mixed = mixing.mix(docs, block_words=100, blocks_per_shard=4)
    # dropping both columns keeps the order: shards stay whole and their places in a row
    rows = mixed.select("shard", "place", F.spark_partition_id().alias("task")).collect()
    assert len({r["shard"] for r in rows}) > 3 and len({(r["shard"], r["task"]) for r in rows}) == len({r["shard"] for r in rows})
    assert all(b["place"] == (a["place"] + 1 if a["shard"] == b["shard"] else 1) for a, b in zip(rows, rows[1:]))
    assert "Window" in mixed.select("doc_id")._jdf.queryExecution().executedPlan().toString()
    plan = mixing.make_plan(docs, block_words=100, blocks_per_shard=4)
    made = len(spark.sparkContext._cubeloom_work)
    got = sorted(map(str, mixing.taken_words(docs, plan).collect()))
    assert [p for p in spark.sparkContext._cubeloom_work[made:] if "/mixed-" in p]
    drawn = mixing.draw(docs, plan)
    taken = (F.col("_size") * F.size("draws")).cast("long").alias("taken")
    assert got == sorted(map(str, drawn.select("doc_id", F.col("_size").alias("size"), "source_size", "target", taken).collect()))
    plain = edge_docs.drop(*CLASH)
    assert mixing.taken_words(plain, mixing.make_plan(plain)).count() == edge_docs.count()


def brute_components(texts, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_jaccard_matches_brute_force(spark, edge_docs, no_docs):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(14):
        base = [f"t{rng.integers(0, 400)}" for _ in range(int(rng.integers(3, 90)))]
        shared = [f"common{i}" for i in range(25)] if rng.random() < 0.5 else []
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[rng.integers(0, len(w))] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(w + shared))
    texts += ["a", "A", "a b c", "a b c d", "", None, texts[0].upper(), texts[0]]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df).collect()}
    sizes, roots = brute_components(texts)
    assert got == {i: (n, r) for i, (n, r) in enumerate(zip(sizes, roots))}
    edge = jaccard.similar_documents(edge_docs).collect()
    assert len(edge) == edge_docs.count()
    by = {r["doc_id"]: r["component_id"] for r in edge}
    assert by[6] == 5 and by[8] == by[7] == 7 and by[1] == 1 and by[2] == 2 and by[3] == 3
    assert jaccard.similar_documents(no_docs).count() == 0


def test_small_sets_link_below_85_percent(spark):
    """At 80 %: 4 of 5 and 5 of 6 shingles link, 3 of 4 do not; the limit follows the percentage."""
    def text(name, count, words):
        return " ".join(f"{name}{i}" for i in range(count + words - 1))

    for words in (4, 5):
        texts = [text("a", 4, words), text("a", 5, words), text("b", 5, words), text("b", 6, words), text("c", 3, words), text("c", 4, words)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(df, words, 80).collect()}
        assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
    assert [jaccard.only_equal(n, 85) for n in range(1, 9)] == [True] * 5 + [False] * 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(1, 1), (300, 301), (301, 300), (259, 139), (400, 398), (400, 399)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    want = {**{i: 5 for i in [5, *range(100, 141), *range(200, 260)]}, 300: 300, 301: 300, 398: 398, 399: 398, 400: 398}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        w = [f"word{rng.integers(0, 50)}" for _ in range(30)]
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, "en", "good" if good and rng.random() < 0.8 else "mixed", len(text)))
        if i % 8 < 5:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cotraining_scores_held_out_documents(labelled):
    docs, labels = labelled
    got = quality.classify(docs, labels).collect()
    assert len(got) == 400
    unseen = [r for r in got if r["doc_id"] % 8 >= 5]
    assert np.mean([r["keep"] == (r["doc_id"] % 3 > 0) for r in unseen]) >= 0.97
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_pseudo_labels_help_a_view_with_few_labels():
    rng = np.random.default_rng(3)
    y = (rng.random(2000) < 0.5).astype(float)
    a = y[:, None] * 3 + rng.standard_normal((2000, 2))
    b = y[:, None] * 1.5 + rng.standard_normal((2000, 20)) * 2
    alone = quality.cotrain(a[:60], b[:60], y[:60], a[:0], b[:0])
    both = quality.cotrain(a[:60], b[:60], y[:60], a[60:1200], b[60:1200])
    right = [np.mean((m.score(a[1200:], b[1200:])[1] > 0.5) == y[1200:]) for m in (alone, both)]
    assert right[1] > right[0]


def test_quality_edge_cases(spark, edge_docs, no_docs, labelled):
    labels = labelled[1]
    got = quality.classify(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([(None, None)], "doc_id long, quality int")
    assert all(r["keep"] and r["score"] == 1 for r in quality.classify(edge_docs, none).collect())
    assert quality.classify(no_docs, labels).count() == 0
