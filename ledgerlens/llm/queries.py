"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table
from . import (bpe, fingerprint, mixing, near_dups, personal_data, quality_crf, secrets,
               token_files, toxicity_fm, url_filter, vector_queries, vector_search)
from .batches import documents
from .labelled import fold

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", vector_search.whole_numbers(F.col("embedding")).alias("v"))
    return vector_search.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = cut_lineage(mixing.mixture(documents(spark, sf_dir))
                        .withColumn("row_id", F.monotonically_increasing_id()))
    ranks = mixing.training_order(mixed, "row_id").groupBy("row_id").agg(
        F.sort_array(F.collect_list("rank")).alias("ranks"))       # one rank for each pass
    return mixed.join(ranks, "row_id", "left").select(
        "doc_id", "size", "source_size", "target", "taken",
        F.col("turns.at").alias("positions"), "ranks")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, sf_dir))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "checked")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.spelled(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spelled(spans).alias("spans"))


def op4_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(documents(spark, sf_dir), width=4, similarity=0.8)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read_table(spark, sf_dir, "labels")
    machine = toxicity_fm.train(docs, labels, fold("doc_id", 5) != 0)
    return toxicity_fm.score(docs, machine).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, bad`` of the labelled pages. A page's path names its document
    (``/en/123``); it is bad if that is labelled low quality or toxic (one known label is
    enough)."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"^/[a-z]+/(\d{1,18})", 1)
    named = (pages.select(url_filter.host_of(F.col("url")).alias("host"), number.alias("number"))
             .where("number != ''").withColumn("doc_id", F.col("number").cast("long")))
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    judged = (labels.where("doc_id is not null and (quality is not null or toxic is not null)")
              .groupBy("doc_id").agg(F.max((low | toxic).cast("int")).alias("bad")))
    return named.join(judged, "doc_id").select("host", "bad")


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = page_outcomes(pages, read_table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, outcomes).select(
        "page_id", "host", "path", "rule", "verdict",
        F.round("bad_share", 9).alias("bad_share"), F.round("bound", 9).alias("bound"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read_table(spark, sf_dir, "labels")
    crf = quality_crf.train(docs, labels, fold("doc_id", 3) != 1)
    return quality_crf.score(docs, crf).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.write_and_read(spark, documents(spark, sf_dir), tokenizer_path(), END_ID)
    return read.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode_decode(documents(spark, sf_dir), tokenizer_path())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(documents(spark, sf_dir))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in personal_data.KINDS],
        F.sha2(secrets.spelled(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_topk, op2_curriculum_mix, op3_secret_scan, op4_minhash_near_dups,
        op5_toxicity_fm, op6_url_reputation, op7_quality_crf, op8_token_files,
        op9_bpe_automaton, op10_fingerprints, op12_personal_data, pipeline)
} | vector_queries.QUERIES

ORACLES: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
          SELECT vec_id, min([floor(64 * x::DOUBLE)::BIGINT for x in embedding]) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
          GROUP BY vec_id),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
          WHERE q.vec_id % 20 = 0)
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20""",
    "op4_minhash_near_dups": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w
          FROM documents),
        sh AS (
          SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
          FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i
                FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b
          FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n
          HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach(doc_id, other) AS (
          SELECT doc_id, doc_id FROM documents
          UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id,
               d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c
          USING (doc_id)""",
    "op6_url_reputation": r"""
        WITH cut AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        label AS (
          SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT)
                   AS bad
          FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)
          GROUP BY doc_id),
        seen AS (
          SELECT host, count(*) AS n, sum(bad) AS bad
          FROM cut JOIN label ON doc_id = try_cast(
            nullif(regexp_extract(path, '^/[a-z]+/(\d{1,18})', 1), '') AS BIGINT)
          GROUP BY host),
        parts AS (
          SELECT host, string_split(host, '.') AS p, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad
          FROM (SELECT DISTINCT host FROM cut) LEFT JOIN seen USING (host)),
        hosts AS (
          SELECT host, array_to_string(p[-2:], '.') AS domain, p[-1] AS suffix, n, bad FROM parts),
        domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
        grouped AS (
          SELECT 'host' AS level, n, bad FROM hosts UNION ALL
          SELECT 'domain', n, bad FROM domains UNION ALL SELECT 'suffix', n, bad FROM suffixes),
        totals AS (
          SELECT level, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, count(*)::DOUBLE AS g,
                 sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS bb
          FROM grouped WHERE n > 0 GROUP BY level),
        rhos AS (
          SELECT level, CASE WHEN g > 1 AND b > 0 AND b < n AND n > g THEN
            ((bb - n * (b / n) * (b / n)) - (b / n) * (1 - b / n) * (g - 1))
            / ((b / n) * (1 - b / n) * (n - nn / n - (g - 1))) END AS rho FROM totals),
        strength AS (
          SELECT max(m) FILTER (level = 'host') AS mh, max(m) FILTER (level = 'domain') AS md,
                 max(m) FILTER (level = 'suffix') AS ms
          FROM (SELECT level, CASE WHEN rho > 0
                  THEN greatest(1.0, least(10000.0, (1 - rho) / rho)) ELSE 10000.0 END AS m
                FROM rhos)),
        one AS (
          SELECT coalesce(mh, 10000.0) AS mh, coalesce(md, 10000.0) AS md,
                 coalesce(ms, 10000.0) AS ms,
                 coalesce((SELECT sum(bad)::DOUBLE / nullif(sum(n), 0) FROM suffixes), 0) AS mean
          FROM strength),
        s AS (SELECT suffix, (ms * mean + bad) / (ms + n) AS mean FROM suffixes, one),
        d AS (SELECT domain, (md * s.mean + bad) / (md + n) AS mean
              FROM domains JOIN s USING (suffix), one),
        h AS (SELECT host, n, (mh * d.mean + bad) / (mh + n) AS p, mh
              FROM hosts JOIN d USING (domain), one),
        rules(rh, rp, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
          ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        ruled AS (
          SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule,
                 arg_max(says, length(rh || rp)) AS says
          FROM cut LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh))
                                  AND starts_with(path, rp)
          GROUP BY ALL)
        SELECT page_id, host, path, rule,
               coalesce(says, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
               round(p, 9) AS bad_share, round(bound, 9) AS bound
        FROM ruled JOIN (SELECT *, p - 1.645 * sqrt(p * (1 - p) / (mh + n + 1)) AS bound FROM h)
          USING (host)""",
} | vector_queries.ORACLES
