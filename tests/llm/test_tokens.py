"""Encoding, packing, token files and token counts against whole-text encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Regex, Tokenizer, pre_tokenizers

from cubeloom.llm import packing, tokencount, tokenfile
from cubeloom.llm.common import work_path
from cubeloom.llm.tokens import SegmentEncoder, encoder, text_chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_segments_give_the_ids_of_the_whole_text(whole):
    random.seed(4)
    letters = " \t\n\r\x0b\x1c 　ab1,.'s!?-_é中<|endoftext|>\U0001f600"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 50))) for _ in range(4000)]
    texts += [None, "", " ", "  a", "a  b   c \n\n d's I'll ", "x" * 3000, "ªº straße, naïve."]
    encoder = SegmentEncoder(PATH, entries=200)  # the caches turn over all the time
    for lo in range(0, len(texts), 500):
        for text, ids in zip(texts[lo : lo + 500], encoder.ids(texts[lo : lo + 500])):
            assert np.frombuffer(ids, "<u4").tolist() == whole(text)


def test_letters_are_encoded_once_whatever_follows_them(whole):
    encoder, met = SegmentEncoder(PATH), []
    joined, single = encoder.encode_joined, encoder._encode
    encoder.encode_joined = lambda pieces, *how, **named: (met.extend(pieces), joined(pieces, *how, **named))[1]
    encoder._encode = lambda pieces: (met.extend(pieces), single(pieces))[1]
    text = "a zorbalique, zorbalique. zorbalique.%%% x\n(y zorbalique.\nThe zorbaliqué, zorbalique"
    assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == whole(text)
    assert met.count("zorbalique") == 1 and sum("zorbalique" in piece for piece in met) == 1


def test_cut_pieces_give_the_ids_of_the_whole_text(whole):
    random.seed(9)
    stems = ["of", "Été", "ªº", "straßɏ", "naı̈ve", "ɐb", "中文", "don't", "x1", "²", "", "Ǆa", "'s", "’s", "_"]
    tails = ["", ".", ",", ".\n", "\n", "\n\n", "\r\n", ".%%%", "12", "'", "'s", "'.", ".'ll", "\x1c", "\x00", "\u00a0", "\u0301", "<|endoftext|>", "\t"]
    texts = [" ".join("".join(random.choice(part) for part in (stems, tails) * 2) for _ in range(random.randint(1, 9))) for _ in range(3000)]
    encoder = SegmentEncoder(PATH, entries=300)
    for lo in range(0, len(texts), 100):
        for text, ids in zip(texts[lo : lo + 100], encoder.ids(texts[lo : lo + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == whole(text)


def test_other_pre_tokenizers_see_whole_pieces(tmp_path):
    other = Tokenizer.from_file(PATH)
    runs = pre_tokenizers.Split(Regex(r" ?[\p{L}.]+|\s+|[^\s]"), "isolated")  # letters and dots are one pre-token
    other.pre_tokenizer = pre_tokenizers.Sequence([runs, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    text = "an end. an end, the.end.\nThe end.. end"
    encoder = SegmentEncoder(str(tmp_path / "other.json"))
    assert not encoder.parted and np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == other.encode(text).ids


def test_chunks_cover_every_text_once():
    texts = ["a" * n for n in (5, 0, 90, 3, 3, 200, 500)] + [None, "", None]
    parts = list(text_chunks(pa.array(texts), 100))
    assert [t for _, _, part in parts for t in part.to_pylist()] == texts and len(parts) >= 3
    assert [i for lo, hi, _ in parts for i in range(lo, hi)] == list(range(len(texts)))
    assert list(text_chunks(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("lengths", [{5: 3}, {10: 2, 1: 7}, {7: 4, 3: 9, 2: 1}, {i: i % 4 + 1 for i in range(1, 11)}])
def test_packs_hold_every_piece_once_without_gaps(lengths):
    packs = {}
    for length, first, count, sequence, offset in packing.shortest_pack_first(lengths, 10):
        for i in range(count):
            packs.setdefault(sequence + i, []).append((offset, length))
    assert sorted(packs) == list(range(len(packs)))
    for parts in packs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 10
    assert sum(len(p) for p in packs.values()) == sum(lengths.values())


def test_packing_edge_cases(edge_docs, no_docs, whole):
    got = packing.pack(edge_docs, PATH, max_len=64).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    assert sum(r["length"] for r in got) == sum(len(whole(r["text"])) + 1 for r in rows)
    for r in rows:
        if r["doc_id"] not in (None, 7):
            pieces = sorted((p for p in got if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
            ids = b"".join(bytes(p["ids"]) for p in pieces)
            assert np.frombuffer(ids, "<u4").tolist() == whole(r["text"]) + [1]
            assert all(p["doc_tokens"] == len(ids) // 4 for p in pieces)
    ends = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 64 and sorted(ends) == list(range(len(ends)))
    assert packing.pack(no_docs, PATH).count() == 0


@pytest.mark.parametrize("percentile", [50, 95, 100])
def test_streams_round_trip(percentile):
    rng = np.random.default_rng(2)
    for high in (1, 2, 200, 257, 50257, 1 << 24, 1 << 32):
        for n in (0, 1, 255, 256, 1000):
            values = rng.integers(0, high, n).astype(np.uint32)
            if n > 10:
                values[rng.integers(0, n, 3)] = rng.integers(0, 1 << 32, 3)
            data = tokenfile.encode_stream(values, percentile)
            back, used = tokenfile.decode_stream(memoryview(data))
            assert used == len(data) and np.array_equal(back, values)


def test_a_broken_shard_is_refused():
    image = tokenfile.encode_shard(np.array([2], np.uint32), np.array([7, 0], np.uint32))
    assert tokenfile.decode_shard(image)[1].tolist() == [7, 0]
    with pytest.raises(ValueError):
        tokenfile.decode_shard(b"XXXX" + image[4:])


def test_token_files_round_trip(spark, edge_docs, no_docs, whole):
    path = work_path(spark, "test-token-files")
    tokenfile.write_token_files(edge_docs, path, PATH, shard_tokens=500)
    got = tokenfile.read_token_files(spark, path).collect()
    assert len(got) == edge_docs.count()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect() if r["doc_id"] is not None}
    at = 0
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order[2:]] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    for r in order:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == whole(texts[r["doc_id"]]) + [0]
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokenfile.token_file_digest(spark, path).collect()}
    assert digest == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in got}
    hot = spark.createDataFrame([(7, f"text {i}") for i in range(50)] + [(i, "x") for i in range(14)], "doc_id long, text string").repartition(3)
    folder = work_path(spark, "test-token-files")
    tokenfile.write_token_files(hot, folder, PATH)
    assert [r["doc_id"] for r in sorted(tokenfile.read_token_files(spark, folder).collect(), key=lambda r: r["start"])] == sorted(
        [7] * 50 + [*range(14)]
    )
    assert spark.read.parquet(folder).count() > 1
    empty = work_path(spark, "test-token-files")
    tokenfile.write_token_files(no_docs, empty, PATH)
    assert tokenfile.read_token_files(spark, empty).count() == 0


def brute_sections(text, spans, whole, rule, sizes):
    """Token by token over bytes."""
    data, owner = text.encode(), []
    for i, c in enumerate(text):
        inside = [k for k, (s, e) in enumerate(spans) if s <= i < e]
        owner += [inside[0] if inside else -1] * len(c.encode())
    counts, at = {}, 0
    for t in whole(text):
        mine = owner[at : at + sizes[t]]
        at += sizes[t]
        if rule == "share":
            for k in mine:
                counts[k] = counts.get(k, 0) + 1 / len(mine)
            continue
        order = sorted(set(mine), key=lambda k: (-mine.count(k), k if k >= 0 else 10**9))
        k = {"first": mine[0], "last": mine[-1], "most": order[0]}[rule]
        counts[k] = counts.get(k, 0) + 1
    assert at == len(data)
    return counts


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_tokens_are_attributed_by_the_rule(spark, whole, rule):
    text = "Résumé of wonderful things\nline two, 中文 here\nend"
    spans = [(0, 5), (5, 13), (15, 31), (31, 40)]
    df = spark.createDataFrame([(1, text, [(s, e) for s, e in spans])], "doc_id long, text string, s array<struct<start:long,end:long>>")
    got = {r["section"]: r["n_tokens"] for r in tokencount.section_tokens(df, PATH, rule, "s").collect()}
    want = brute_sections(text, spans, whole, rule, encoder(PATH).sizes)
    assert {k: v for k, v in got.items() if v} == pytest.approx(want)


def test_lines_count_every_token_once(edge_docs, no_docs, whole):
    got = tokencount.section_tokens(edge_docs, PATH).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    assert sum(r["n_tokens"] for r in got) == sum(len(whole(r["text"])) for r in rows)
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows}
    nine = sorted((r["section"], r["start"], r["end"]) for r in got if r["doc_id"] == 9)
    text = next(r["text"] for r in rows if r["doc_id"] == 9)
    assert "".join(text[s:e] for _, s, e in nine) == text and len(nine) == 3
    assert [(r["n_tokens"], r["doc_tokens"]) for r in got if r["doc_id"] == 1] == [(0, 0)]
    assert tokencount.section_tokens(no_docs, PATH).count() == 0
