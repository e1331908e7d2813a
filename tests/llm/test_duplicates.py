from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from knitgraph.llm import components as C
from knitgraph.llm import jaccard, quality, substrings
from knitgraph.llm import text as T
from knitgraph.plans import Workspace


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def corpus(seed=5, docs=60):
    """Shared passages, self-repeats, periodic texts, copies, near copies and odd rows."""
    rng = random.Random(seed)
    passage = prose(rng, 90)
    out = []
    for i in range(docs):
        body = prose(rng, rng.randint(1, 160))
        if i % 3 == 0:
            at, size = rng.randint(0, 40), rng.randint(30, 50)
            body[len(body) // 2 : len(body) // 2] = passage[at : at + size]
        if i % 7 == 0:
            body += body[:40]
        out.append((i, " ".join(body)))
    for i in range(20):
        copied = out[rng.randrange(10)][1].split()
        for _ in range(rng.randint(0, 6)):
            copied[rng.randrange(len(copied))] = "edit"
        out.append((100 + i, " ".join(copied).title() if i % 5 == 0 else " ".join(copied)))
    out += [(200, "x " * 80), (201, "a b " * 40), (202, None), (203, ""), (204, "\t \n"), (205, "one two"), (206, "ONE two")]
    return out + [out[3], out[3], (None, out[4][1]), (None, None)]


@pytest.mark.parametrize("hot, words", [(2000, 1 << 20), (1, 400)])
def test_removed_words_equal_plain_python(monkeypatch, documents, hot, words):
    monkeypatch.setattr(substrings, "HOT_RUNS", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", words)
    pairs = corpus()
    found = [tuple(r) for r in substrings.removed_words(documents(pairs)).collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(found, key=key) == sorted(plain.removed_words(pairs), key=key)


def test_stripped_documents_keep_the_rest_of_their_text(documents):
    shared = " ".join(f"s{i}" for i in range(40))
    docs = documents([(1, f"first  line\n{shared}\nend é"), (2, f"{shared} tail"), (3, "as\tit  is"), (4, None)]).withColumn("spans", F.lit(1))
    rows = {r.doc_id: r for r in substrings.strip_documents(docs).collect()}
    assert {i: r.text for i, r in rows.items()} == {1: "first  line\nend é", 2: "tail", 3: "as\tit  is", 4: None}
    assert (rows[2].n_chars, rows[4].n_chars, rows[1].spans) == (4, 0, 1)
    assert substrings.strip_documents(docs.limit(0)).columns == docs.columns
    assert substrings.strip_documents(docs.limit(0)).count() == 0


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 6, 399), 0)  # closed, as every piece is
    index = substrings.FmIndex(text, np.ones(400, dtype=np.int64), 8)
    for at in range(0, 390, 7):
        low, high = np.array([0]), np.array([400])
        pattern = text[at : at + 5]
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        assert high[0] - low[0] == sum((text[i : i + 5] == pattern).all() for i in range(396))


@pytest.mark.parametrize("block, star", [(5000, 20000), (3, 2)])
def test_components_equal_plain_python(monkeypatch, documents, block, star):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "STAR", star)
    pairs = corpus(6)
    found = jaccard.link_documents(documents(pairs)).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(plain.link_components(pairs), key=key)


def test_links_at_the_threshold(documents):
    """3 of 4 shingles in common is a link, 3 of 5 is none; chains connect."""
    base = "a b c d e f g"  # 3 shingles
    pairs = [(1, base), (2, base + " h"), (3, base + " h i"), (4, "z " + base + " y"), (5, "q r s t u v")]
    found = {r.doc_id: r.component_id for r in jaccard.link_documents(documents(pairs)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5} == {i: c for i, _, c in plain.link_components(pairs)}


def test_one_document_of_each_group_stays(documents):
    pairs = corpus(7)
    docs = documents(pairs).withColumn("cls", F.lit("own"))
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    found = [r.doc_id for r in kept.filter("trim(replace(replace(text, '\\t', ''), '\\n', '')) <> ''").collect()]
    expected = sorted({c for i, n, c in plain.link_components(pairs) if n})
    assert sorted(found) == expected
    assert kept.filter("text IS NULL").count() == 2
    assert jaccard.keep_one_of_each(docs.limit(0)).count() == 0


def test_group_bounds_never_fall_below_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        shared = rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64)
        sets = [np.unique(np.append(shared, rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64))) for _ in "ab"]
        grams, offsets = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        vectors, cuts = jaccard.count_vectors(grams, offsets)
        rows = [vectors[cuts[i] : cuts[i + 1]] for i in range(2)]
        x, y, _ = jaccard.close_pairs(np.diff(offsets), rows, np.arange(2), np.full(2, 2), 1)
        overlap = len(np.intersect1d(*sets))
        if 7 * overlap >= 3 * (len(sets[0]) + len(sets[1])):
            assert len(x) == 1


def test_a_large_group_of_near_copies_sends_few_pairs(documents, monkeypatch):
    """600 texts around two templates: far fewer pairs are sent than there are in the groups."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    templates = [[word() for _ in range(120)] for _ in range(2)]
    pairs = []
    for i in range(600):
        text = list(templates[i % 2])
        for at in rng.sample(range(120), 1 + i % 2):
            text[at] = word()
        pairs.append((i, " ".join(text)))
    rows = []
    save = Workspace.save

    def counted(self, df, name, **measures):
        staged = save(self, df, name, **measures)
        if name == "survivors":
            rows.append(staged.rows)
        return staged

    monkeypatch.setattr(Workspace, "save", counted)
    monkeypatch.setattr(jaccard, "MIN_HASHES", 1)
    found = {r.doc_id: r.component_id for r in jaccard.link_documents(documents(pairs)).collect()}
    assert found == {i: c for i, _, c in plain.link_components(pairs)}
    assert sum(rows) < 600 * 599 // 2 // 10


def test_thinned_pairs_hold_the_nearest_of_each_member(monkeypatch):
    monkeypatch.setattr(jaccard, "HELD_PAIRS", 40)
    rng = np.random.default_rng(6)
    sizes = rng.integers(20, 30, size=40)
    bound = {(x, y): int(rng.integers(18, 20)) for x in range(40) for y in range(x + 1, 40)}
    for width in (1, 3, 100):
        found = jaccard._Nearest(sizes, width)
        for x in range(39):
            y = np.arange(x + 1, 40)
            found.add(np.full(len(y), x), y, np.array([bound[x, j] for j in y]))
        pairs = set(zip(*(part.tolist() for part in found.thin()), strict=True))
        share = lambda x, y: bound[min(x, y), max(x, y)] / (sizes[x] + sizes[y] - bound[min(x, y), max(x, y)])
        for x in range(40):
            best = sorted((y for y in range(40) if y != x), key=lambda y: (-share(x, y), y))[:width]
            assert all((min(x, y), max(x, y)) in pairs for y in best)
        assert found.cut == (width < 39) and (width < 39 or len(pairs) == 780)


def test_saturated_counts_bound_large_sets():
    """More than 255 shingles in a group: the bound must not fall below the overlap."""
    sizes = np.array([300_000, 300_000])
    vectors = [np.full(4096, 255, dtype=np.uint8)] * 2
    x, y, _ = jaccard.close_pairs(sizes * 100, vectors, np.arange(2), np.full(2, 2), 1)
    assert (x.tolist(), y.tolist()) == ([0], [1])


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, v) for v in range(101, 140)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "a bigint, b bigint")
    found = {r.node: r.root for r in C.components(links, Workspace(spark, "test")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {v: 100 for v in range(101, 140)}
    assert C.components(links.limit(0), Workspace(spark, "test")).count() == 0


def test_long_words_with_equal_polynomials_are_told_apart(documents):
    """The Thue-Morse word of 1,024 letters and its complement: equal under every polynomial modulo 2**64."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    filler = [f"w{i}" for i in range(60)]
    texts = [" ".join([*filler[:30], word, *filler[30:]]) for word in (thue, other)]
    # 34 words are no window of 35; the fifth words around the long one differ.
    pairs = [(1, " ".join([thue, *filler[:34]])), (2, " ".join([other, *filler[:34]])), (3, thue + " x y z v"), (4, other + " x y z v")]
    found = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.link_documents(documents(pairs)).collect()}
    assert found == {i: (c, n) for i, n, c in plain.link_components(pairs)} and found[3][0] == 3 and found[4][0] == 4
    removed = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed_words(documents(enumerate(texts))).collect()]
    assert sorted(removed) == sorted(plain.removed_words(list(enumerate(texts))))
    lines = f"{thue}\n{other}\n{thue} a b c d {other} a b c d"
    found = quality.rule_statistics(documents([(1, lines)])).first()
    assert tuple(found[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain.rule_statistics(lines)


def test_words_and_hashes_of_odd_texts():
    import pyarrow as pa

    texts = ["", None, "a", " a b c\x1cd ", "x\ty\vz", "é è", "end"]
    x = T.Texts(pa.array(texts))
    data = x.data.tobytes()
    found = [[data[a:b] for a, b in zip(x.start[i:j], x.end[i:j], strict=True)] for i, j in zip(x.word_offsets, x.word_offsets[1:], strict=False)]
    assert found == [plain.words(t) for t in texts]
    again = T.Texts(pa.array(["pad a", "a"]))
    assert again.word_hashes()[1] == again.word_hashes()[2] == x.word_hashes()[0]


def test_spans_of_repeated_rows_are_kept_once(spark, documents):
    """3,000 rows of one id and text gather the spans of one row, not 3,000 times them."""
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    docs = documents([(1, text)] * 3000 + [(2, text), (3, "another text")])
    work = Workspace(spark, "spans")
    sizes = {r.doc_id: r.n for r in substrings.repeated_intervals(docs, work).select("doc_id", F.size("spans").alias("n")).collect()}
    assert sizes[1] == sizes[2] <= 300 and 3 not in sizes
    removed = {(r.doc_id, r.n_removed) for r in substrings.removed_words(docs).collect()}
    assert removed == {(1, 300), (2, 300), (3, 0)}
