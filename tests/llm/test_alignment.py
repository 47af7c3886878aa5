"""Alignment of two tokenizers against whole-text encoding and the definitions."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cubeloom.llm import alignment
from cubeloom.llm.tokens import byte_characters

from .conftest import CLASH

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "  x ", "é", "中文", " ", "\n", "\r\n", "\t", "<0x0A>", "<s>", "<|endoftext|>", "\u3000", "\u200b", "don't", "12", "\x00", "\U0001f600", "word,", "e\u0301", "\xa0", "\x1c"]


@functools.cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B), {c: b for b, c in byte_characters().items()}


def whole_text(text):
    """(a ids, b ids, groups as lists) of the whole text, None without tokens."""
    a, b, characters = libraries()
    if not text:
        return None
    want = (" " + text).encode()
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(characters[c] for c in a.id_to_token(i)) for i in left]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in right)]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    ends = []
    for side in (bytes_a, bytes_b):
        at, mine = 0, []
        for t in side:
            at += len(t)
            mine.append(at)
        ends.append(mine)
    closes = sorted(set(ends[0]) & set(ends[1]))
    groups, i, j = [], 0, 0
    for c in closes:
        x, y = i, j
        while i < len(left) and ends[0][i] <= c:
            i += 1
        while j < len(right) and ends[1][j] <= c:
            j += 1
        groups.append((left[x:i], right[y:j]))
    return left, right, groups


def expected(rows):
    found = [whole_text(t) for _, t in rows]
    counts = Counter()
    for f in found:
        counts.update({(x, y) for ga, gb in (f[2] if f else []) for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (name, _), f in zip(rows, found):
        if f is None:
            out.append((name, 0, 0, 0, 0, "", 0, 0))
            continue
        links = [(x, y) for ga, gb in f[2] for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in f[2])
        out.append((name, len(f[0]), len(f[1]), len(f[2]), len(links), hashlib.sha256(text.encode()).hexdigest(),
                    sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)))
    return sorted(map(str, out))


def answers(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted(str(tuple(r[n] for n in names)) for r in df.collect())


def random_text(rng):
    return "".join(rng.choice(ODD + [" ", " the", " hello", " Wörter", " zxqv"]) for _ in range(rng.randint(0, 60)))


def test_composition_is_associative_and_equals_the_whole():
    worker = alignment.Aligner(A, B)
    align = lambda pieces: alignment.Closed.of(worker.align([pieces])[0])
    rng = random.Random(5)
    for _ in range(300):
        text = " " + random_text(rng)
        want = alignment.finish(alignment.fragment(text, align), align)
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(1, 6)))
        parts = [alignment.fragment(text[i:j], align) for i, j in zip([0, *cuts], [*cuts, len(text)])]
        while len(parts) > 1:  # any bracketing
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [alignment.compose(parts[i], parts[i + 1], align)]
        got = alignment.finish(parts[0], align)
        assert (got.n_a, got.n_b, got.n_groups, b"".join(got.pairs)) == (want.n_a, want.n_b, want.n_groups, b"".join(want.pairs))
        assert [g for g in got.groups if g] == [g for g in want.groups if g] or ";".join(filter(None, got.groups)) == ";".join(filter(None, want.groups))


@pytest.mark.parametrize("chunk,share", [(1 << 16, 1 / 500), (7, 0.5), (64, 0.02)])
def test_documents_equal_brute_force(spark, chunk, share):
    rng = random.Random(chunk)
    rows = [(i, random_text(rng)) for i in range(120)] + [(120, None), (121, ""), (122, "a \u2581 b"), (None, "no id here"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answers(alignment.cross_alignment(df, A, B, chunk, 3, share)) == expected(rows)


def test_query_on_the_documents_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = alignment.op11_alignment(spark, "/root/testdata/sf0.001")
    assert answers(got) == expected(rows) and got.count() == len(rows)


def test_odd_rows(spark, edge_docs, no_docs):
    got = alignment.cross_alignment(edge_docs, A, B)  # two texts are longer than a chunk
    assert set(CLASH).isdisjoint(got.columns)
    assert answers(got) == expected([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert alignment.cross_alignment(no_docs, A, B).count() == 0


def test_chunks_are_cut_between_characters():
    text = "a中" * 50 + "\U0001f600"
    for size in (1, 2, 3, 5, 100, 1000):
        parts = alignment.chunks_of(text, size)
        assert "".join(parts) == text and all(parts) and (size < 5 or max(len(p.encode()) for p in parts) <= size + 3)
