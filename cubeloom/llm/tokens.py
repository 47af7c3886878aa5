"""Exact byte-level BPE ids of whole texts, encoded once per distinct segment.

The pre-tokenizer of a byte-level BPE never lets a token run from a character that is not white space into
white space that follows it. A text may therefore be cut before such white space, and the ids of the cuts,
joined, are the ids of the whole text. Words repeat, so a bounded cache of encoded segments saves most of
the merge work; it changes the time and never the ids.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# a Spark task has its own core: threads of the tokenizers library would only contend with the other tasks
os.environ["TOKENIZERS_PARALLELISM"] = "false"

from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

# A cut lies before an ASCII blank that follows a character no white-space definition includes.
CUT = re.compile(r"(?<=\S)(?=[ \t-\r])")
# A space after white space is no cut.
RUNS = tuple(chr(i) + " " for i in range(0x3001) if chr(i).isspace())
RUN = "[" + "".join(f"\\x{{{ord(r[0]):x}}}" for r in RUNS) + "] "
# What may follow a word's letters in a piece; an apostrophe may be part of a pre-token with letters.
TAIL = "".join(c for c in map(chr, range(128)) if not c.isalpha() and c != "'")
KNOWN = "\u0250"  # letters below are letters in every Unicode version
JOINED = 1024  # segments that are encoded as one text
CACHE_ENTRIES = 600_000  # of each of two generations


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def token_sizes(tokenizer: Tokenizer) -> np.ndarray:
    """Bytes of every id: a byte-level token's text has one character per byte; special tokens stand for their own bytes."""
    special = {t["id"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token.encode()) if i in special else len(token)
    return sizes


def token_cuts(ids: np.ndarray, sizes: np.ndarray, pieces: list[str]) -> np.ndarray:
    """How many ids lie before the end of each piece, when the ids encode the pieces with a space before each."""
    stops = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)) + 1)
    ends = np.cumsum(sizes[ids])
    cuts = np.searchsorted(ends, stops)
    if len(ends) == 0 or cuts[-1] != len(ends) - 1 or not np.array_equal(ends[cuts], stops):
        raise ValueError("a token of the vocabulary runs over a space")
    return cuts + 1


def byte_level(text: str, shown: dict[int, str]) -> str:
    """Words with a space before each as byte-level characters, parted by spaces."""
    if text.isascii():  # letters stand for themselves
        return text.replace(" ", " " + shown[32])
    return text.encode().decode("latin-1").translate(shown).replace(shown[32], " " + shown[32])


def strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls; much faster than to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Store:
    """Ids of encoded segments: ``slots`` names a segment's place in the arrays."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i] and ends[i + 1] bound the ids of slot i

    def find(self, keys: list[str]) -> np.ndarray:
        """Slots of the keys, -1 where a key is not known."""
        return np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.slots)
        used = int(self.ends[first])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(ids)] = ids
        self.ends[first + 1 : first + len(keys) + 1] = used + np.cumsum(counts)
        self.slots.update(zip(keys, range(first, first + len(keys))))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots in their order, and how many each has."""
        starts = self.ends[slots]
        counts = self.ends[slots + 1] - starts
        places = np.repeat(starts - (np.cumsum(counts) - counts), counts)
        places += np.arange(len(places))
        return self.ids[places], counts


class SegmentEncoder:
    """Encodes lists or Arrow arrays of texts to little-endian unsigned 32-bit ids.

    A text in which no white space stands before a space is cut at every space: its first piece is meant as it stands, every other
    with a space before it. Any other text is cut at CUT. Segments meant as they stand are kept under a key with a space before it.
    Where the pre-tokenizer is the usual byte-level one, letters and what follows them in a piece are looked up apart, and pieces of
    letters alone, which are one pre-token each, meet the model without being searched for pre-tokens.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.entries = entries
        self.sizes = token_sizes(self.tokenizer)
        shape = json.loads(self.tokenizer.to_str())
        split = shape["pre_tokenizer"] or {}
        self.parted = shape["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        with contextlib.suppress(AttributeError):
            self.tokenizer.model._resize_cache(0)  # words are kept here, and come once
        self.shown = byte_characters()
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.store = Store()
        self.older = Store()  # the generation before, from which segments in use come back

    def _encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for start in range(0, len(segments), 8192):
            part = self.tokenizer.encode_batch_fast(segments[start : start + 8192], add_special_tokens=False)
            found.extend([f.ids for f in part])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def encode_joined(self, pieces: list[str], letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pieces meant with a space before them, which end in no white space: many in one text, parted by their bytes."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = [" " + " ".join(pieces[start : start + JOINED]) for start in range(0, len(pieces), JOINED)]
        if letters:
            parts = [byte_level(p, self.shown) for p in parts]
        tokenizer = self.letters if letters else self.tokenizer
        found = [f.ids for f in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        return ids, np.diff(token_cuts(ids, self.sizes, pieces), prepend=0)

    def _add_pieces(self, pieces: list[str]) -> None:
        """Adds new pieces that end in no white space."""
        if not self.parted:
            self.store.add(pieces, *self.encode_joined(pieces))
            return
        letters: list[str] = []
        other: list[str] = []
        tailed: dict[str, tuple[str, ...]] = {}
        lines: dict[str, tuple[str, ...]] = {}
        for piece in pieces:
            stem = piece.rstrip(TAIL)
            if stem.isalpha() and (stem.isascii() or max(stem) < KNOWN):
                if len(stem) == len(piece):
                    letters.append(piece)
                else:
                    tailed[piece] = stem, " " + piece[len(stem) :]
                continue
            line, end, after = piece.partition("\n")
            if end and line and not line[-1].isspace() and after[0].isalpha() and after[0] < KNOWN:
                lines[piece] = line, " \n", " " + after  # one line end before a letter is a pre-token
            else:
                other.append(piece)
        self.store.add(letters, *self.encode_joined(letters, letters=True))
        self.store.add(other, *self.encode_joined(other))
        self._add_cut(tailed)
        self._add_cut(lines)  # a line may be one of the pieces above

    def _add_cut(self, cuts: dict[str, tuple[str, ...]]) -> None:
        """Adds new pieces whose ids are those of their parts."""
        if not cuts:
            return
        parts = list(dict.fromkeys(chain.from_iterable(cuts.values())))
        slots = self._slots(parts)
        place = dict(zip(parts, slots.tolist()))
        ids, counts = self.store.gather(np.fromiter(map(place.__getitem__, chain.from_iterable(cuts.values())), np.int64))
        self.store.add(list(cuts), ids, counts.reshape(len(cuts), -1).sum(axis=1))

    def _slots(self, keys: list[str]) -> np.ndarray:
        """Slots of distinct keys; each one not known yet is encoded once."""
        store = self.store
        slots = store.find(keys)
        places = np.flatnonzero(slots < 0)
        if len(places) == 0:
            return slots
        missing = [keys[i] for i in places.tolist()]
        old = self.older.find(missing)
        back = old >= 0
        if back.any():
            store.add(list(compress(missing, back)), *self.older.gather(old[back]))
        new = list(compress(missing, ~back)) if back.any() else missing
        joined = [k for k in new if k and k[0] != " " and not k[-1].isspace()]
        self._add_pieces(joined)
        if len(joined) < len(new):
            # a piece's tail may be among these, and is known by now
            new = [k for k in new if k not in store.slots]
            whole = [k for k in new if k and k[0] == " "]
            spaced = [k for k in new if not k or (k[0] != " " and k[-1].isspace())]
            store.add(whole, *self._encode([k[1:] for k in whole]))
            store.add(spaced, *self._encode([" " + k for k in spaced]))
        slots[places] = store.find(missing)
        return slots

    def flat_ids(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and how many each text has; null and empty texts have none."""
        collecting = gc.isenabled()
        gc.disable()  # only acyclic lists are made here, in great number
        try:
            return self._flat_ids(texts)
        finally:
            if collecting:
                gc.enable()

    def _flat_ids(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.store.slots) > self.entries:
            self.older, self.store = self.store, Store()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if len(column) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        runs = pc.match_substring_regex(column, RUN).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(column.filter(pa.array(~runs)), " ")
        ends = plain.offsets.to_numpy()
        words = plain.flatten()
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        heads = words.take(pa.array(ends[:-1])).dictionary_encode()
        names = [*strings(coded.dictionary), *[" " + h for h in strings(heads.dictionary)]]
        at[ends[:-1]] = heads.indices.to_numpy() + len(coded.dictionary)
        pieces = np.zeros(len(column), np.int64)
        pieces[~runs] = np.diff(ends)
        if runs.any():
            cut = [[" " + s for s in CUT.split(t)] for t in column.filter(pa.array(runs)).to_pylist()]
            pieces[runs] = [len(c) for c in cut]
            number = {k: len(names) + i for i, k in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
            names += number
            every = np.empty(pieces.sum(), np.int64)
            mine = np.repeat(runs, pieces)
            every[~mine] = at
            every[mine] = [number[k] for c in cut for k in c]
            at = every
        distinct = list(dict.fromkeys(names)) if runs.any() else names
        slots = self._slots(distinct)
        if len(distinct) < len(names):  # a head and a run's segment may be the same
            place = dict(zip(distinct, slots.tolist()))
            slots = np.array([place[n] for n in names], np.int64)
        ids, counts = self.store.gather(slots[at])
        sums = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(pieces)])]
        return ids, np.diff(sums)

    def ids(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """One byte string per text; null and empty texts give no ids."""
        ids, counts = self.flat_ids(texts)
        data = ids.astype("<u4").tobytes()
        stops = (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> SegmentEncoder:
    """The encoder of this Python worker."""
    return SegmentEncoder(path, entries)


def release() -> None:
    """Frees the words an earlier task left in this Python worker, and gives what is free back to the system."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc keeps freed memory until it is asked
        ctypes.CDLL(None).malloc_trim(0)


def lean(task):
    """A task function over batches that leaves an idle Python worker small: workers of all stages stay alive side by side."""

    def run(batches: Iterator) -> Iterator:
        release()
        try:
            yield from task(batches)
        finally:
            release()

    return run


def text_chunks(column: pa.Array, size: int = 3_000_000) -> Iterator[tuple[int, int, pa.Array]]:
    """(from, to, texts) of about ``size`` bytes each, so a batch of very long texts stays small in memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        done = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, done + size)) + 1, start + 1)
        end = min(end, len(column))
        yield start, end, column.slice(start, end - start)
        start = end
