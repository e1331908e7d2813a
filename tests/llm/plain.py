"""Plain-Python answers, written independently of the operators."""

from __future__ import annotations

import hashlib
from collections import Counter

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


def rule_statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    found = words(text)
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = set()
    for i in range(len(found) - 4):
        if windows[tuple(found[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(found), sum(len(w.decode()) for w in found), symbols, dup, len(covered)


def removed_words(pairs, width=35):
    """[(id, n_words, n_removed, digest)] over all rows."""
    lists = [(i, words(text)) for i, text in pairs]
    count = Counter(tuple(w[at : at + width]) for _, w in lists for at in range(len(w) - width + 1))
    out = []
    for i, w in lists:
        gone = set()
        for at in range(len(w) - width + 1):
            if count[tuple(w[at : at + width])] > 1:
                gone.update(range(at, at + width))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def shingles(text):
    w = (text or "").encode().translate(_LOWER).split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def link_components(pairs):
    """[(id, set size, smallest id reachable)] over all rows."""
    sets = [(i, shingles(text)) for i, text in pairs]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                one, other = sorted((find(a), find(b)))
                root[other] = one
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(s), least.get(find(a))) for a, (i, s) in enumerate(sets)]
