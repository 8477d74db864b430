"""Queries of the training-data operators, with SQL where SQL can say the same.

Each query applies its operator, with the parameters meant for production, to
the whole of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, toxicity
from .common import table
from .contamination import contaminated_spans, digest
from .divergence import divergence
from .exact_dedup import exact_dedup
from .ngram_join import near_duplicates
from .secret_scan import digest as secret_digest
from .secret_scan import find_secrets
from .sharding import shard_rows
from .suffix_dedup import repeated_spans
from .token_counts import token_counts
from .url_filter import SITE_RULES, WORD_RULES, judge_urls
from .whitening import by_component, whiten


def _fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixing_rates(docs, docs.withColumn("domain", F.col("lang")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.where((_fold(4) != 2) & F.col("lang").isNotNull()))
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(_fold(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted", "clauses")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85).drop("n_same")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(table(spark, sf_dir, "embeddings")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op3_token_counts": op3_token_counts,
    "op7_source_mixing": op7_source_mixing,
    "op2_language_id": op2_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_secret_scan": op13_secret_scan,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _url_sql() -> str:
    """The URL rules as one CASE, strongest first."""
    sites = sorted(SITE_RULES, key=lambda r: -r.weight)
    host = lambda r: r.name.partition("/")[0]
    fits = lambda r: f"(host = '{host(r)}' OR ends_with(host, '.{host(r)}')) AND starts_with(path, '{r.name[len(host(r)):]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in sites)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in sites)
    words = " ".join(f"WHEN regexp_matches(host || path, '{r.pattern}') THEN '{r.verdict}'" for r in sorted(WORD_RULES, key=lambda r: -r.weight))
    return f"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {words} ELSE 'allow' END AS verdict FROM u"""


SQL = {
    "op4_url_filters": _url_sql(),
    "op5_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
             n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
             link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
             e AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = w.doc_id""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op6_benchmark_decontamination": rf"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
             win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM bi),
             sizes AS (SELECT DISTINCT k FROM win),
             di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k),
             hits AS (SELECT di.doc_id, di.i, di.k, win.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM di) di JOIN win ON win.k = di.k AND win.p = di.p),
             wordhits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
             itemhits AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN wordhits USING (doc_id) LEFT JOIN itemhits USING (doc_id)""",
    "op11_source_divergence": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
             kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
             c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
             v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
             g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
             p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
                                FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, kept.term)),
             q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
                   FROM p JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
             summed AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
                        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
             pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
                      LEFT JOIN summed s ON (s.lang, s.source, s.item) = (x.lang, x.source, y.source)),
             term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op10_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d WHERE length(h) >= 200)),
             later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
             marked AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM later),
             runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM marked) GROUP BY doc_id, n),
             gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM runs),
             kept AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
