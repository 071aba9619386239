"""Byte-level BPE encoding and decoding by ranks.

Pre-tokens are encoded many at a time. Their symbols lie in one array and form doubly linked lists,
one a pre-token. Every adjacent pair that has a merge rank sits in that rank's bucket, which holds
list positions. The set of non-empty buckets is a hierarchy of 64-bit words (a 64-ary tree over all
ranks): find-first-set from the root gives the lowest rank in as many steps as the tree has levels.
All places of that rank merge at once, from the left where they overlap; what the merges make
goes into the buckets of its own ranks. Old entries stay behind; they are recognised as stale when
their bucket comes up (the pair that starts there has another rank by now) and skipped. Where a
merge makes a pair of the same or a lower rank, later places of that pre-token are put back, since
that pair goes first. A pre-token of n bytes costs O(n log n) where a rescan costs O(n^2).

Cases: null text is empty; an empty text has no ids; texts of any length are encoded whole;
special tokens in a text are ordinary text; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from memlake.llm.common import map_batches

#: Entries of each of a worker's two memo generations; longest chunk (characters) that is remembered.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
#: Bytes of pre-tokens encoded together.
TOGETHER = 4 << 20


class RankQueue:
    """Buckets of positions by rank, with a hierarchical bitmap of those that aren't empty."""

    def __init__(self, size: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            size = -(-size // 64) or 1
            self.levels.append([0] * size)

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            had = level[word]
            level[word] = had | bit
            if had:
                break
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 1:
            return self.push(int(ranks[0]), positions)
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = [0, *cuts.tolist()]
        for rank, a, b in zip(ranks[firsts].tolist(), firsts, [*firsts[1:], len(ranks)], strict=True):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and what its bucket held; None if all are empty."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = (rank << 6) | ((word & -word).bit_length() - 1)
        at = rank
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


class PairTable:
    """Rank of a pair of symbols, -1 if it doesn't merge: open addressing over int64 keys."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(4 * len(rank)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        key, rank = (left.astype(np.int64) << 32) | right, rank.astype(np.int32)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]  # of several for one slot the last stays
            own = self.keys[at] == key
            self.ranks[at[own]] = rank[own]
            key, rank, at = key[~own], rank[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], np.int32(-1))
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Merger:
    """Merges pre-tokens down to ids. ``made[rank]`` is the symbol that a merge of that rank makes;
    ``single`` and ``final`` are the symbols of a byte, within a pre-token and at its end."""

    def __init__(self, pairs: PairTable, made: np.ndarray, single: np.ndarray, final: np.ndarray):
        self.pairs, self.made, self.single, self.last = pairs, made, single, final
        self.queue = RankQueue(len(made))

    def merge(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the (non-empty) pre-tokens in ``raw`` one after the other, and each one's count."""
        n = len(raw)
        ends = np.cumsum(lengths) - 1
        piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        symbol = self.single[raw]
        symbol[ends] = self.last[raw[ends]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = n
        before[ends[:-1] + 1] = -1
        symbol = np.append(symbol, np.int32(-1))  # at n, and at -1: no neighbour
        due = np.full(n + 1, -1, np.int32)
        at = np.flatnonzero(after < n)
        due[at] = self.pairs.find(symbol[at], symbol[at + 1])
        at = at[due[at] >= 0]
        queue, made = self.queue, self.made
        if len(at):
            queue.push_all(due[at], at)
        while (top := queue.pop()) is not None:
            rank, at = top
            at = at[due[at] == rank]  # the rest is stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
            every = at
            if len(at) > 1:
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # of overlapping places every other one, from the left
                    k = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(np.append(True, ~chained), k, 0))
                    at = at[(k - first) % 2 == 0]
            new = made[rank]
            gone, left = after[at], before[at]
            right, left_symbol = after[gone], symbol[left]
            if len(at) > 1:  # a left neighbour that merges in this step too will be the new symbol
                left_symbol[1:][left[1:] == gone[:-1]] = new
            news = np.full(len(at), new)
            both = self.pairs.find(np.concatenate([news, left_symbol]), np.concatenate([symbol[right], news]))
            on_right, on_left = both[: len(at)], both[len(at) :]
            if len(at) > 1 and ((both >= 0) & (both <= rank)).any():
                low = ((on_right >= 0) & (on_right <= rank)) | ((on_left >= 0) & (on_left <= rank))
                bad = np.unique(piece[at[low]])
                again = np.append(False, piece[every[1:]] == piece[every[:-1]]) & np.isin(piece[every], bad)
                queue.push(rank, every[again]) if again.any() else None
                stay = ~(np.append(False, piece[at[1:]] == piece[at[:-1]]) & np.isin(piece[at], bad))
                at, gone, right, on_right, on_left = at[stay], gone[stay], right[stay], on_right[stay], on_left[stay]
            symbol[at] = new
            symbol[gone] = -2
            due[gone] = -1
            after[at] = right
            inside = right < n
            before[right[inside]] = at[inside]
            due[at] = on_right
            left = before[at]
            has = left >= 0
            due[left[has]] = on_left[has]
            touched = np.concatenate([at, left[has]])
            touched = touched[due[touched] >= 0]
            if len(touched):
                queue.push_all(due[touched], touched)
        alive = symbol[:n] != -2
        return symbol[:n][alive], np.bincount(piece[alive], minlength=len(lengths))


#: Classes of bytes: white space, letter (with all bytes of Latin letters beyond ASCII), digit, other.
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
#: A character that isn't ASCII or a Latin letter below U+0250, or that the classes alone don't split.
HARD = re.compile("[^\x00-\x1b\x20-\x26\x28-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")


class Encoder:
    """Encodes texts by a merger, with a memo of chunks that a text can be cut into without any
    effect on its ids.

    ``cut`` gives a text's chunks. Chunks of plain characters are split into pre-tokens by byte
    classes, all at once; with ``spaced`` a chunk's leading space belongs to its first word, with
    ``lone`` each digit is a pre-token, with ``lower`` letters are lower-cased first. ``hard`` gives
    the pre-tokens of any other chunk, or its ids. ``whole`` holds pre-tokens that are ids as they
    stand although merging doesn't lead to them."""

    def __init__(self, merger: Merger, cut: Callable[[str], list[str]], hard: Callable[[str], list[bytes] | bytes], spaced: bool = False, lone: bool = False, lower: bool = False):
        self.merger, self.cut, self.hard, self.spaced, self.lone, self.lower = merger, cut, hard, spaced, lone, lower
        self.whole: dict[bytes, int] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of chunks."""
        found = {c: got for c in fresh if (got := self.older.get(c)) is not None}
        fresh = [c for c in fresh if c not in found] if found else fresh
        plain = fresh
        if HARD.search("\n".join(fresh)):
            plain = []
            for chunk in fresh:
                if not HARD.search(chunk):
                    plain.append(chunk)
                elif isinstance(got := self.hard(chunk), bytes):
                    found[chunk] = got
                else:
                    ids, counts = self._ids(np.frombuffer(b"".join(got), np.uint8), np.array([len(p) for p in got]))
                    found[chunk] = ids.astype("<u4").tobytes()
        at = 0
        while at < len(plain):
            own, size = [], 0
            while at < len(plain) and size < TOGETHER:
                own.append(plain[at])
                size += len(plain[at])
                at += 1
            coded = [c.encode() for c in own]
            if self.lower:
                coded = [c.lower() if c.isascii() else t.lower().encode() for c, t in zip(coded, own, strict=True)]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            raw = np.frombuffer(b"".join(coded), np.uint8)
            kinds, starts = CLASS[raw], np.cumsum(sizes) - sizes
            new = np.append(True, kinds[1:] != kinds[:-1])
            if self.lone:
                new |= kinds == DIGIT
            if self.spaced:
                led = starts[(kinds[starts] == SPACE) & (sizes > 1)] + 1
                new[led] = False
            new[starts] = True
            firsts = np.flatnonzero(new)
            ids, counts = self._ids(raw, np.diff(np.append(firsts, len(raw))))
            ends = np.append(0, np.cumsum(counts))
            bounds = (4 * ends[np.append(np.searchsorted(firsts, starts), len(firsts))]).tolist()
            packed = ids.astype("<u4").tobytes()
            found.update(zip(own, [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))
        return found

    def _ids(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.merger.merge(raw, lengths)
        if self.whole:
            ends, at = np.cumsum(lengths), np.cumsum(counts)
            sizes = {len(w) for w in self.whole}
            for k in np.flatnonzero(np.isin(lengths, list(sizes))):
                if (one := self.whole.get(raw[ends[k] - lengths[k] : ends[k]].tobytes())) is not None:
                    ids[at[k] - counts[k]] = one
                    ids[at[k] - counts[k] + 1 : at[k]] = -1
                    counts[k] = 1
            ids = ids[ids >= 0]
        return ids, counts

    def encode_texts(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cuts = [self.cut(t) if t else [] for t in texts]
        memo = self.memo
        fresh = set(itertools.chain.from_iterable(cuts)).difference(memo)
        found = self._learn(list(fresh)) if fresh else {}
        long = {c: v for c, v in found.items() if len(c) > MEMO_CHARS}
        if len(memo) + len(found) > MEMO_ENTRIES:
            self.older, self.memo = memo, {}
            found |= {c: memo[c] for c in set(itertools.chain.from_iterable(cuts)).intersection(memo)}
            memo = self.memo
        memo.update(found)
        out = [b"".join(map(memo.__getitem__, own)) for own in cuts]
        for c in long:
            del memo[c]
        return out


def rank_encoder(path: str, pattern: str) -> tuple[Encoder, list[bytes]]:
    """Encoder for a file of base64 tokens and ranks, where a pair merges if its joint bytes have a
    rank; and the bytes of each id. A text is cut at white space, as the pattern does in any case."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pairs = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    left, right, rank = np.array(pairs, np.int64).T
    size = max(ranks.values()) + 1
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    merger = Merger(PairTable(left, right, rank), np.arange(size, dtype=np.int32), single, single)
    tokens = [b""] * size
    for token, r in ranks.items():
        tokens[r] = token
    find = regex.compile(pattern).findall
    fast, exact = re.compile(CHUNK).findall, regex.compile(CHUNK).findall

    def cut(text: str) -> list[str]:
        # Python's re takes four control characters for white space that the pattern doesn't.
        return exact(text) if CONTROLS.search(text) else fast(text)

    out = Encoder(merger, cut, lambda chunk: [p.encode() for p in find(chunk)], spaced=True)
    every = list(ranks)
    _, counts = merger.merge(np.frombuffer(b"".join(every), np.uint8), np.array([len(t) for t in every]))
    out.whole = {t: ranks[t] for t, n in zip(every, counts.tolist(), strict=True) if n != 1}
    return out, tokens


#: Cuts at white space only: a space before a word belongs to it, other runs of white space stand alone.
CHUNK = r" ?\S+|\s+(?!\S)|\s+"
CONTROLS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it
    is printable Latin-1, else the next character from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def word_encoder(path: str) -> Encoder:
    """Encoder with the ids of the ``tokenizers`` library for a vocabulary with word ends: NFC, lower
    case, white space dropped. Neither its normaliser nor its pattern looks across white space, so
    a text is cut there; chunks that aren't plain go through the library itself."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    with open(path) as file:
        model = json.load(file)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
    made = np.array([vocab[a + b] for a, b in merges], np.int32)
    letters = byte_letters()
    single, final = (np.array([vocab[c + e] for c in letters], np.int32) for e in ("", end))

    def cut(text: str) -> list[str]:
        return [text] if CONTROLS.search(text) else text.split()

    def hard(chunk: str) -> bytes:
        return np.array(own.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    return Encoder(Merger(PairTable(left, right, np.arange(len(merges))), made, single, final), cut, hard, lone=True, lower=True)


_KEPT: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """One encoder a worker process, kept for its later tasks."""
    if (make, *args) not in _KEPT:
        _KEPT[make, *args] = make(*args)
    return _KEPT[make, *args]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Ids and round trip of each whole text: doc_id, ids array<int>, decoded binary."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, tokens = kept(rank_encoder, ranks_path, pattern)
        ids = [np.frombuffer(x, "<i4") for x in encoder.encode_texts(batch["text"].to_pylist())]
        decoded = [b"".join(map(tokens.__getitem__, x.tolist())) for x in ids]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As ``encode_documents``, but each document's ids and decoded bytes leave the worker as SHA-256."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, tokens = kept(rank_encoder, ranks_path, pattern)
        said, rows = [str(i) for i in range(len(tokens))], []
        for raw in encoder.encode_texts(batch["text"].to_pylist()):
            ids = np.frombuffer(raw, "<u4").tolist()
            text = " ".join(map(said.__getitem__, ids)).encode()
            rows.append((len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest()))
        n, a, b = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
