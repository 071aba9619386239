"""Licence scan by matching statistics against a generalised suffix automaton.

The templates' words are numbered and all templates enter one suffix automaton over word numbers. A
document's words stream through it; at each word the automaton's state and length say how long a
stretch that ends here occurs in some template (the matching statistics). Where the statistics stop
growing a maximal match ends. The phrases of the base rules are templates too, so each place of a
phrase lies in a maximal match and is read off the template that matched.

Long enough matches are chained per template by dynamic programming: in order both in the document and
in the template, with gaps of at most ``GAP`` words; the best chain that ends in each match covers the
most words. Chains that cover at least ``COVER`` of a template's words give its label and span; of
overlapping ones of a template the one that covers most counts, so two copies give two spans.

The automaton has at most twice as many states as the templates have words: it is built once in each
worker and its size doesn't depend on the documents. Time is linear in the words.

Cases: null or empty text has no words, no label and score 0; repeated rows give repeated results;
an empty table gives no rows; other columns are not read. Score: the largest covered share of a
template, 0 to 1.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm.common import map_batches, utf8
from memlake.llm.license_texts import PHRASES, TEMPLATES

#: Words between two matches of a chain; share of a template to cover; shortest match that starts a
#: chain in templates of more words than that.
GAP, COVER, MATCH = 8, 0.8, 4
#: Lower-cases A-Z; ASCII characters that aren't letters or digits separate words.
SEPARATED = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(SEPARATED).split()


class Automaton:
    """Suffix automaton of all templates; ``ends`` of a state: (template, word number after the match)."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seen: list[set[tuple[int, int]]] = [set()]
        for t, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word, seen)
                seen[last].add((t, at + 1))
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            seen[self.link[state]] |= seen[state]
        self.ends = [sorted(s) for s in seen]

    def _state(self, length: int, seen: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        seen.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, word: int, seen: list) -> int:
        if (old := self.next[last].get(word)) is not None:
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old, seen)
        new, p = self._state(self.length[last] + 1, seen), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q, seen)
        return new

    def _split(self, p: int, word: int, q: int, seen: list) -> int:
        clone = self._state(self.length[p] + 1, seen)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def matches(self, words: list[int]) -> list[tuple[int, int, int]]:
        """Maximal matches (end, length, state) of a sequence of word numbers."""
        out, state, length = [], 0, 0
        for at, word in enumerate(words):
            follow = self.next[state].get(word)
            if follow is None and length:
                out.append((at, length, state))
            while follow is None and state:
                state = self.link[state]
                length = self.length[state]
                follow = self.next[state].get(word)
            if follow is None:
                length = 0
            else:
                state, length = follow, length + 1
        if length:
            out.append((len(words), length, state))
        return out


class Scanner:
    def __init__(self) -> None:
        templates = [*TEMPLATES, *[(label, phrase) for phrase, label in PHRASES]]
        texts = [words_of(t.encode()) for _, t in templates]
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.texts = [[self.number[w] for w in t] for t in texts]
        self.labels = [label for label, _ in templates]
        self.automaton = Automaton(self.texts)
        # Where the phrases stand in each template: (start, length, label).
        phrases = [(self.texts[len(TEMPLATES) + k], label) for k, (_, label) in enumerate(PHRASES)]
        self.phrases = [[(at, len(p), label) for p, label in phrases for at in range(len(t)) if t[at : at + len(p)] == p] for t in self.texts]

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], list[tuple[str, int, int, float]]]:
        """Starts of base phrases, their labels, and chains (label, start, end, share of the template)."""
        numbers = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[False], numbers >= 0, [False]]).astype(np.int8))).reshape(-1, 2)
        found = []
        for a, b in known[known[:, 1] - known[:, 0] >= 2].tolist():
            found += [(a + end - n, n, state) for end, n, state in self.automaton.matches(numbers[a:b].tolist())]
        places: dict[int, str] = {}
        for start, n, state in found:
            t, stop = self.automaton.ends[state][0]  # the same words in every template that has them
            places |= {start + at - (stop - n): label for at, size, label in self.phrases[t] if stop - n <= at and at + size <= stop}
        return sorted(places), set(places.values()), self.chains(found)

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches (start, length, state); of those of a template that overlap the best one."""
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for start, n, state in sorted(found):
            for t, stop in self.automaton.ends[state]:
                if n >= min(MATCH, len(self.texts[t])):
                    by_template[t].append((start, n, stop))
        out = []
        for t, matches in by_template.items():
            size, taken = len(self.texts[t]), [(-1, -1)]  # by place, none overlaps another
            for covered, start, end in sorted(chained(matches), key=lambda c: (-c[0], c[1], c[2])):
                k = bisect(taken, (start, end))
                if taken[k - 1][1] <= start and (k == len(taken) or end <= taken[k][0]):
                    taken.insert(k, (start, end))
                    out.append((self.labels[t], start, end, covered / size))
        return out


def chained(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The best chain (covered words, start, end) that ends in each match (start, length, end in the template) of one
    template, by start. A match follows one whose ends are at most GAP words before its starts, here and there."""
    out: list[tuple[int, int, int]] = []
    open_: list[int] = []  # matches that one may still follow
    for k, (start, n, stop) in enumerate(matches):
        open_ = [j for j in open_ if matches[j][0] + matches[j][1] + GAP >= start]
        best = n, start, start + n
        for j in open_:
            s, m, e = matches[j]
            if s + m <= start and 0 <= stop - n - e <= GAP and out[j][0] + n > best[0]:
                best = out[j][0] + n, out[j][1], start + n
        out.append(best)
        open_.append(k)
    return out


_KEPT: list[Scanner] = []


def scanner() -> Scanner:
    if not _KEPT:
        _KEPT.append(Scanner())
    return _KEPT[0]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the spans of
    covered templates (label, start, end, share)."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
            words = words_of(text)
            places, base, found = scanner().scan(words)
            spans = [dict(zip(("label", "start", "end", "share"), x, strict=True)) for x in found if x[3] >= COVER]
            labels = base | {x["label"] for x in spans}
            rows.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max([min(x[3], 1.0) for x in found], default=0.0), spans))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, start long, end long, share double>>")
