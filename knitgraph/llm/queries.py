"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitgraph.llm import (
    centroids, extraction, jaccard, languages, licenses, packing, pieces, quality, substrings, toxicity, variants, vectors, warc,
)
from knitgraph.llm.ship import ship
from knitgraph.plans import Workspace

def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; the folder is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Results as SQL, where SQL can express them on whole tables.
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(spark, folder)

        QUERIES[name] = run
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "anomaly")


@query("op2_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learned = docs.filter(toxicity.remainder(F.col("doc_id"), 4) != 2)
    model = toxicity.fit(learned, table(spark, folder, "labels"))
    held_out = toxicity.remainder(F.col("doc_id"), 4) == 2
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "worst_start", "worst_end"
    )


@query("op4_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.removed_words(table(spark, folder, "documents"))


@query("op10_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_documents(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_retrieval_packing")
def retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op5_warc_archives")
def warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    work = Workspace(spark, "warc")
    archives = work.next_path("archives")
    index = work.save(warc.write_archives(table(spark, folder, "pages"), archives), "index").df
    return warc.read_records(index, archives, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


@query("op6_sampled_pieces")
def sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op7_exact_top_k")
def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return vectors.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


ORACLES["op7_exact_top_k"] = """
WITH usable AS (
  SELECT row_number() OVER () AS n, vec_id,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op8_language_mixture")
def language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = toxicity.remainder(F.col("doc_id"), 5) == 0
    model = languages.fit(docs.filter(~held_out))
    return languages.predict_languages(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_languages"
    )


@query("op9_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op4_substring_dedup"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="text")} AS ws FROM documents
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS t
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY t) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(generate_series(i, i + 34)) AS p FROM dup)
), placed AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM placed ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLES["op5_warc_archives"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
o AS (SELECT h, min(page_id) AS origin FROM p WHERE strlen(h) >= 100 GROUP BY h HAVING count(*) > 1),
j AS (SELECT p.*, CASE WHEN origin < page_id OR page_id IS NULL THEN origin END AS refers_to FROM p LEFT JOIN o USING (h))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url
FROM j
"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op10_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text=_LOWERED)} AS ws FROM documents
), sets AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT r, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM sets GROUP BY r
), links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM sets x JOIN sets y USING (s) WHERE x.r <> y.r GROUP BY ALL)
  JOIN sizes m ON m.r = a JOIN sizes k ON k.r = b WHERE 100 * c >= 75 * (m.n + k.n - c)
), reach(r, o) AS (
  SELECT r, r FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o
), least AS (
  SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN least USING (r) LEFT JOIN sizes USING (r)
"""


@query("op11_centroid_clustering")
def centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_report(*centroids.cluster_vectors(table(spark, folder, "embeddings")))


def _clustering_sql(rounds: int = centroids.ROUNDS) -> str:
    """Lloyd's rounds written out one after the other."""
    gap = "CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, m)]) AS BIGINT)"
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {centroids.DIM} AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT v, sha256('{centroids.SEED}:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {centroids.CENTROIDS})
)"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, min({{'d': {gap}, 'c': c}}) AS best FROM v, c{i} GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (
  SELECT best.c AS c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i} JOIN v USING (r)) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(k, m) AS m
  FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS k FROM s{i} GROUP BY c) USING (c)
)""")
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = best.c
"""


ORACLES["op11_centroid_clustering"] = _clustering_sql()


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


@query("op13_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_pages(table(spark, folder, "pages"), extraction.fit(extraction.labelled_pages(spark)))
