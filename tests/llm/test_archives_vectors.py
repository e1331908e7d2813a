from __future__ import annotations

import gzip
import hashlib

import numpy as np
from pyspark.sql import functions as F

from knitgraph.llm import vectors, warc
from knitgraph.plans import Workspace

PAGES = "page_id bigint, url string, html string"


def build(spark, pages):
    work = Workspace(spark, "warc")
    folder = work.next_path("archives")
    index = work.save(warc.write_archives(pages, folder), "index")
    return index.df, folder


def test_archives_round_trip(spark, tmp_path):
    same, small = "é" * 60, "x" * 99
    rows = [
        (5, "http://a/", same), (3, "http://b/?q=1%20\r\nX: y", same), (9, None, same), (1, "u", small), (2, "u", small),
        (7, "", None), (8, "v", ""), (None, "n", same), (4, "w", "crlf\r\n\r\nWARC/1.1\r\n" * 9), (3, "twice", same),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumn("offset", F.lit("own")).withColumn("digest", F.lit(1))
    index, folder = build(spark, pages)
    found = warc.read_records(index, folder).collect()
    expected = []
    for i, url, html in rows:
        body = (html or "").encode()
        refers = 3 if html == same and i != 3 else None
        kind = "response" if refers is None else "revisit"
        stored = body if refers is None else b""
        expected.append((i, url, len(body), hashlib.sha256(body).hexdigest(), kind, refers, stored))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([(*r[:6], bytes(r[6])) for r in found], key=key) == sorted(expected, key=key)
    some = warc.read_records(index.filter("page_id IN (1, 9)"), folder, with_payload=False)
    assert sorted(r.page_id for r in some.collect()) == [1, 9] and "payload" not in some.columns
    assert build(spark, pages.limit(0))[0].count() == 0


def test_archives_are_gzip_members_in_order(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"body {i} " * 30) for i in range(50)], PAGES).coalesce(1)
    index, folder = build(spark, pages)
    rows = index.orderBy("offset").collect()
    assert len({r.archive for r in rows}) == 1
    with open(f"{folder.removeprefix('file:')}/{rows[0].archive}", "rb") as file:
        data = file.read()
    assert len(data) == sum(r.length for r in rows) and gzip.decompress(data).count(b"WARC/1.1\r\n") == 50
    for r in rows:
        assert warc.parse(gzip.decompress(data[r.offset : r.offset + r.length]))["page_id"] == r.page_id


def test_large_archives_are_read_by_several_tasks(spark, monkeypatch):
    """Payloads above a read, archives above their size, and cuts that tasks share out."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 6_000)
    monkeypatch.setattr(warc, "READ_BYTES", 1_000)
    monkeypatch.setattr(warc, "TASK_BYTES", 4_000)
    monkeypatch.setattr(warc, "CUT_BYTES", 2_000)
    rng = np.random.default_rng(2)
    bodies = ["".join(map(chr, rng.integers(33, 120, size=3_000 if i % 9 == 0 else 40))) for i in range(90)]
    pages = spark.createDataFrame([(i, f"u{i}", b) for i, b in enumerate(bodies)], PAGES).coalesce(2)
    index, folder = build(spark, pages)
    assert index.select("archive").distinct().count() > 2
    found = warc.read_records(index, folder)
    assert {r.page_id: bytes(r.payload).decode() for r in found.collect()} == dict(enumerate(bodies))
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 60
    one = index.filter(F.col("archive") == index.first().archive)
    readers = warc.read_records(one, folder).groupBy(F.spark_partition_id()).count().count()
    assert readers > 1


def test_near_ranges_are_one_read():
    places = [(0, 10), (10, 5), (100, 5), (10**6, 10), (10**6 + 10, warc.READ_BYTES)]
    reads = list(warc._ranges(places))
    assert [(a, b, len(i)) for a, b, i in reads] == [(0, 105, 3), (10**6, 10**6 + 10, 1), (10**6 + 10, 10**6 + 10 + warc.READ_BYTES, 1)]
    assert [p for _, _, i in reads for p in i] == places


def brute(rows, k, every):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(90)]
    rows += [(100 + i, list(rows[i % 4][1])) for i in range(12)]  # ties
    rows += [(0, list(rows[0][1])), (300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, []), (None, rows[1][1]), (310, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("own"))
    stored = [(r.vec_id, r.embedding) for r in table.collect()]
    found = vectors.top_k(table, table.filter("vec_id % 5 = 0"), k=5)
    assert sorted(map(tuple, found.collect())) == brute(stored, 5, 5)
    assert vectors.top_k(table.limit(0), table.limit(0)).count() == 0


def test_bounds_stop_early():
    rng = np.random.default_rng(5)
    rows = rng.integers(-128, 128, (500, 16))
    found = vectors.search_block(rows[:3], np.array([0, 1, 2]), rows, np.arange(500), 4)
    for q, (ids, scores) in enumerate(found):
        exact = rows @ rows[q]
        exact[q] = -(10**9)
        best = np.lexsort((np.arange(500), -exact))[:4]
        assert list(ids) == list(best) and list(scores) == list(exact[best])
