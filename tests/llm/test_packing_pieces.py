from __future__ import annotations

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from knitgraph.llm import packing, pieces
from knitgraph.llm import text as T

ODD = [
    None, "", " ", "it's Here's a'S X'll 1234,56 don't, a., .. ,", "İstanbul ΣΣΣ. क़क, é é x y x\x1cz ▁ 한국어. ﬁ",
    "<|endoftext|> a<|startoftext|>b <|endoftext|>, |<|endoftext|>| (word) \"Quoted!\" $$$ -été- ***Ünï*** a'b 'tis rock'n", "  two  spaces\n\nlines \t tab ", "😀 x" * 30, "▁▁ a ▁b",
]


def test_word_ids_equal_the_tokenizer(spark, smallest, tokenizers_folder):
    from tokenizers import Tokenizer

    path = os.path.join(tokenizers_folder, "word_bpe_49k.json")
    texts = ODD + [r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()]
    whole = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    found = packing.WordTokenizer(path)([None if t is None else t.encode() for t in texts])
    assert [list(f) for f in found] == [e.ids for e in whole]


def test_pieces_hold_each_id_once(monkeypatch, documents, tokenizers_folder):
    from tokenizers import Tokenizer

    path = os.path.join(tokenizers_folder, "word_bpe_49k.json")
    monkeypatch.setattr(packing, "SHARD_TOKENS", 9000)
    rng = random.Random(8)
    topic = lambda: rng.choice(["red blue green", "dog cat bird", "sun rain wind"]).split()
    pairs = list(enumerate(ODD)) + [
        (100 + i, " ".join(rng.choices(topic(), k=rng.choice([3, 500, 2000, 9000])))) for i in range(40)
    ]
    pairs += [pairs[-1], pairs[-1], (None, "no id")]
    docs = documents(pairs).withColumn("ids", F.lit(1)).withColumn("offset", F.lit(2))
    found = packing.pack_documents(docs, path).collect()
    encode = Tokenizer.from_file(path).encode
    expected = sorted(
        [(-1 if i is None else i, k) for i, t in pairs for k in [tuple(encode(t or "", add_special_tokens=False).ids) + (2,)]]
    )
    places, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        places[-1 if r.doc_id is None else r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in set(expected):
        copies = sum(e == (i, ids) for e in expected)
        own = sorted(places[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(part.tobytes()))
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    shards = {r.sequence_id >> 32 for r in found}
    assert len(by_sequence) <= sum(len(ids) for _, ids in expected) // packing.WINDOW + len(shards) + 1
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_neighbours_share_a_shard(monkeypatch, documents, tokenizers_folder):
    """Each of 60 documents has a copy with a few other words; by a hash one pair in some 30 would meet."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(3000)]
    pairs = []
    for i in range(60):
        text = rng.sample(words, 200)
        pairs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:190] + rng.sample(words, 10)))]
    found = packing.pack_documents(documents(pairs), os.path.join(tokenizers_folder, "word_bpe_49k.json")).collect()
    shard = {r.doc_id: r.sequence_id >> 32 for r in found}
    assert len(set(shard.values())) >= 8
    assert sum(shard[2 * i] == shard[2 * i + 1] for i in range(60)) >= 40


def test_frequencies_count_whole_documents(monkeypatch, documents, tokenizers_folder):
    seen = []
    pack = packing._pack
    monkeypatch.setattr(packing, "_pack", lambda dealt, weight, mean: seen.append((weight, mean)) or pack(dealt, weight, mean))
    path = os.path.join(tokenizers_folder, "word_bpe_49k.json")
    pairs = [(0, "rare " + "a b " * 5000)] + [(i, f"dog {i}") for i in range(1, 20)]
    packing.pack_documents(documents(pairs), path).count()
    ids = [packing.WordTokenizer(path)([t.encode()], np.uint16(packing.CLOSE).tobytes())[0] for _, t in pairs]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=1 << 16)
    expected = np.where(df > 0, np.maximum(np.log((20 - df + 0.5) / (df + 0.5)), 0), 0)
    weight, mean = seen[0]
    assert np.allclose(weight, expected) and mean == sum(map(len, ids)) / 20


def test_neighbours_follow_bm25():
    units = [np.array(u, dtype=np.uint16) for u in ([1, 2, 3, 9], [4, 5, 6, 9], [1, 2, 7, 9], [4, 5, 8, 9], [20, 21, 22, 9])]
    df = np.bincount(np.concatenate([np.unique(u) for u in units]), minlength=1 << 16)
    weight = np.where(df > 0, np.maximum(np.log((5 - df + 0.5) / (df + 0.5)), 0), 0)
    index = packing.Bm25Index(units, weight, 4.0)
    scores = index.scores(0)
    assert scores[2] > 0 and scores[1] == scores[3] == scores[4] == 0 and scores[0] > scores[2]
    tf, length = 1.0, 4.0
    expected = 2 * weight[1] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 4.0))
    assert scores[2] == pytest.approx(expected)


def test_sampled_pieces_decode_to_the_text(spark, documents, smallest, tokenizers_folder):
    model = os.path.join(tokenizers_folder, "piece_bpe_32k.model")
    pairs = list(enumerate(ODD)) + [(None, "null key"), (3, ODD[3]), (50, "x" * 3000), (51, " " * 100)]
    docs = documents(pairs).unionByName(spark.read.parquet(f"{smallest}/documents.parquet"))
    encoded = pieces.encode_documents(docs, model)
    again = pieces.encode_documents(docs.repartition(7), model)
    assert sorted(map(str, encoded.collect())) == sorted(map(str, again.collect()))
    decoded = pieces.decode_documents(encoded, model)
    assert sorted(map(str, decoded.collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    trip = pieces.round_trip(docs, model)
    assert trip.filter("NOT lossless").count() == 0 and trip.count() == docs.count()
    assert pieces.encode_documents(docs, model, seed=2).exceptAll(encoded).count() > 0
    assert pieces.round_trip(docs.limit(0), model).count() == 0


def test_segmentations_are_drawn_by_weight(tokenizers_folder):
    vocabulary = pieces.Pieces(os.path.join(tokenizers_folder, "piece_bpe_32k.model"))
    word = "then"
    weights = {}

    def walk(at, ids, weight):
        if at == len(word):
            weights[ids] = weight
        for stop in range(at + 1, len(word) + 1):
            known = vocabulary.ids.get(word[at:stop])
            if known:
                walk(stop, (*ids, known[0]), weight * known[1])

    walk(0, (), 1.0)
    n = 40_000
    ids, offsets = vocabulary.encode([word] * n, np.arange(n, dtype=np.uint64))
    drawn = defaultdict(int)
    for a, b in zip(offsets, offsets[1:], strict=False):
        drawn[tuple(ids[a:b])] += 1
    total = sum(weights.values())
    assert set(drawn) <= set(weights)
    for key, weight in weights.items():
        assert drawn[key] / n == pytest.approx(weight / total, abs=0.012)


def unmix(value):
    """The 64-bit integer that text.mix maps to `value`."""
    mask = 2**64 - 1

    def unshift(x, by):
        out = x
        for _ in range(64 // by + 1):
            out = x ^ (out >> by)
        return out

    x = unshift(value, 31) * pow(0x94D049BB133111EB, -1, 2**64) & mask
    x = unshift(x, 27) * pow(0xBF58476D1CE4E5B9, -1, 2**64) & mask
    return unshift(x, 30)


def test_extreme_draws_stay_in_their_lattice(tokenizers_folder):
    """Row keys whose first draw is all ones, or nearly, or zero, on a cache that is full."""
    vocabulary = pieces.Pieces(os.path.join(tokenizers_folder, "piece_bpe_32k.model"))
    assert int(T.mix(np.array([unmix(12345)], dtype=np.uint64))[0]) == 12345
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß\u2581漢", k=rng.randint(1, 12))) for _ in range(290_000)})
    vocabulary.encode(words, np.arange(len(words), dtype=np.uint64))
    assert vocabulary._nodes > 1_900_000
    for first in (2**64 - 1, 2**64 - 1 - 2**30, 2**64 - 2**31, 2**64 - 2**33, 0, 1):
        start = unmix((unmix(first) - 0x9E3779B97F4A7C15) % 2**64)
        key = (start - int(T.mix(np.zeros(1, dtype=np.uint64))[0])) % 2**64
        some = words[:50] + words[-250:]
        ids, offsets = vocabulary.encode(some, np.full(len(some), key, dtype=np.uint64))
        assert [d.decode() for d in vocabulary.decode_all(ids, offsets)] == some


def test_long_chunks_and_full_caches_are_lossless(tokenizers_folder, monkeypatch):
    vocabulary = pieces.Pieces(os.path.join(tokenizers_folder, "piece_bpe_32k.model"))
    texts = ["the" * 5_000 + "\u2581" * 40, "a" * 3_000, "", None, " " * 2_000, "z\U0001f600" * 500]
    keys = np.arange(len(texts), dtype=np.uint64)
    whole = vocabulary.encode(texts, keys)
    assert [d.decode() for d in vocabulary.decode_all(*whole)] == [t or "" for t in texts]
    monkeypatch.setattr(pieces, "_CACHED_NODES", 10)
    for _ in range(2):
        again = vocabulary.encode(texts, keys)
        assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
    assert vocabulary.encode([None, ""], keys[:2])[1].tolist() == [0, 0, 0]
