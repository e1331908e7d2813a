"""License scans: an inverted index of word fingerprints counts candidates, bit-parallel alignment reports them.

Texts are runs of letters and digits, A-Z lower-cased. A match of a template of n words is a span of at most
n + `extra_words(n)` words that holds at least `MIN_COVERAGE` of the template's words in order, whatever is
changed or put between them. No gram of several words must survive such changes, so the fingerprints
are the single words: an inverted index (word, template, occurrences), broadcast after its size is checked against
`MAX_TEMPLATE_WORDS`. A document is a candidate of a template if it shares enough occurrences of words with it,
and so must each span that is aligned; both are necessary for a match, so none is lost. Alignment is the longest
common subsequence, in one integer of n bits that each word of the span updates.

From left to right, the first span that reaches the coverage gives a match: from the last start that its
alignment allows, the most words of the template that the allowed length holds, the earliest end with that many and
the last start. The search goes on behind it. Every template reports for itself, with its coverage.

Defined cases: null and empty texts have no match; templates that are null or have no word
are left out; rows that repeat a document each report; matches of one template do not overlap.
Other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knitgraph.llm import text as T

BAND = 6
MIN_COVERAGE = 0.8
MAX_TEMPLATE_WORDS = 1_000_000

#: Short notices that point to a license.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def templates() -> list[tuple[str, str]]:
    """The short notices, and the public license texts, preambles and standard headers of `license_texts`."""
    files = resources.files(__package__).joinpath("license_texts").iterdir()
    return list(NOTICES.items()) + sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files)


_PART = T.table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


class Tokens:
    """Hashed words of a slice of texts; `first[i]:first[i+1]` are those of text i."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = T.buffers(column)
        inside, cuts = _PART[data], offsets[offsets < len(data)]
        head, last = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        head[cuts] = inside[cuts]
        last[:-1] &= ~inside[1:]
        last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
        start, end = np.flatnonzero(head), np.flatnonzero(last) + 1
        self.words = T.SpanHash(T._BYTE_VALUES[T.lower(data)], T._BYTE_BASE)(start, end)
        self.first = np.searchsorted(start, offsets)
        self.n = len(offsets) - 1


def extra_words(n: int) -> int:
    """How many words more than the template a match may span, as for the name of a holder."""
    return max(2 * BAND, n // 4)


def _places(words: list[int]) -> dict[int, int]:
    """The places of each word, as bits."""
    out: dict[int, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << i
    return out


def _common(places: dict[int, int], n: int, words: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence with `words`, and the words up to the first place that reaches it."""
    full = (1 << n) - 1
    free, steps = full, []
    for word in words:
        hit = free & places.get(word, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
        steps.append(free)
    end = bisect.bisect_left(steps, -free.bit_count(), key=lambda v: -v.bit_count())
    return n - free.bit_count(), end + 1 if free != full else 0


def _aligned(there: dict[int, int], back: dict[int, int], n: int, words: list[int]) -> tuple[int, int, int]:
    """Most words of the template matched in order, and their span: its earliest end, and from that the last start."""
    matched, end = _common(there, n, words)
    return matched, end - _common(back, n, words[:end][::-1])[1], end


def align(template: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Most words of the template matched in order by the words from `shift` on, and their span."""
    own, text = np.asarray(template).tolist(), np.asarray(words)[shift:].tolist()
    matched, start, end = _aligned(_places(own), _places(own[::-1]), len(own), text)
    return matched, start + shift, end + shift


class TemplateIndex:
    """The inverted index of the words of the templates, and the places of the words of each."""

    def __init__(self, wanted: list[tuple[str, str]]) -> None:
        kept = sorted((name, body) for name, body in wanted if name is not None and body)
        tokens = Tokens(pa.array([body for _, body in kept], pa.string()))
        if len(tokens.words) > MAX_TEMPLATE_WORDS:
            raise ValueError("the template list is too large to send to every task")
        self.names = [name for name, _ in kept]
        self.vocabulary, ids = np.unique(tokens.words, return_inverse=True)
        self.size = np.diff(tokens.first)
        # At least one, so that a template without words has no candidates.
        self.needed = np.maximum(np.ceil(MIN_COVERAGE * self.size - 1e-9).astype(np.int64), 1)
        bodies = [ids[a:b].tolist() for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True)]
        self.places = [(_places(body), _places(body[::-1])) for body in bodies]
        owner = np.repeat(np.arange(len(kept)), self.size)
        pairs, self.occurrences = np.unique(ids * max(len(kept), 1) + owner, return_counts=True)
        word, self.owner = np.divmod(pairs, max(len(kept), 1))
        self.first = np.searchsorted(word, np.arange(len(self.vocabulary) + 1))

    def candidates(self, x: Tokens, word: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(text, template) pairs that share as many occurrences of words as a match needs."""
        keys, counts = np.unique(doc * len(self.vocabulary) + word, return_counts=True)
        doc, word = np.divmod(keys, len(self.vocabulary))
        postings = self.first[word + 1] - self.first[word]
        at = T.ranges(self.first[word], postings)
        shared = np.minimum(np.repeat(counts, postings), self.occurrences[at])
        pairs, inverse = np.unique(np.repeat(doc, postings) * len(self.names) + self.owner[at], return_inverse=True)
        total = np.bincount(inverse, shared, minlength=len(pairs))
        pairs = pairs[total >= self.needed[pairs % len(self.names)]]
        return list(zip(*(v.tolist() for v in np.divmod(pairs, len(self.names))), strict=True))

    def matches(self, x: Tokens) -> list[tuple[int, int, float, int, int, int]]:
        """(text, template, coverage, matched words, first word, end) of every match."""
        if not len(self.vocabulary) or not len(x.words):
            return []
        word = np.searchsorted(self.vocabulary, x.words)
        word[word == len(self.vocabulary)] = 0
        known = self.vocabulary[word] == x.words
        word[~known] = -1
        doc = np.repeat(np.arange(x.n), np.diff(x.first))
        found: list[tuple[int, int, float, int, int, int]] = []
        for d, t in self.candidates(x, word[known], doc[known]):
            n = int(self.size[t])
            for matched, start, end in self._spans(t, word[x.first[d] : x.first[d + 1]]):
                found.append((d, t, matched / n, matched, start, end))
        return found

    def _spans(self, t: int, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        there, back = self.places[t]
        n, needed = int(self.size[t]), int(self.needed[t])
        width = n + extra_words(n)
        own = np.zeros(len(self.vocabulary) + 1, dtype=bool)  # the last is for words of no template
        own[list(there)] = True
        place = np.flatnonzero(own[words])  # all other words only take up room
        words = words[place].tolist()
        enough = np.flatnonzero(np.searchsorted(place, place + width) - np.arange(len(place)) >= needed)
        at, next_start = 0, 0
        while at < len(enough):
            s = int(enough[at])
            if s < next_start:
                at = int(np.searchsorted(enough, next_start))
                continue
            matched, first, end = _aligned(there, back, n, words[s : int(np.searchsorted(place, place[s] + width))])
            if matched < needed:
                # A span that starts k words later takes in k words at most.
                next_start = max(s + 1, int(np.searchsorted(place, place[s] + needed - matched)))
                continue
            first += s
            matched, begin, end = _aligned(there, back, n, words[first : int(np.searchsorted(place, place[first] + width))])
            yield matched, int(place[first + begin]), int(place[first + end - 1]) + 1
            next_start = first + end


def scan(docs: DataFrame, wanted: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, coverage, matched words and span (in words of letters and digits) of each match."""
    index = TemplateIndex(templates() if wanted is None else wanted)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                found = shared.value.matches(Tokens(part.column("text")))
                if not found:
                    continue
                doc, template, coverage, matched, start, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array([shared.value.names[t] for t in template]),
                        pa.array(coverage, pa.float64()),
                        *[pa.array(v, pa.int64()) for v in (matched, start, end)],
                    ],
                    ["doc_id", "license", "coverage", "matched_words", "start_word", "end_word"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, license string, coverage double, matched_words bigint, start_word bigint, end_word bigint",
    )
