"""Every registered query of the subpackage on the smallest tables: its SQL, or the laws of its contract."""

import zlib

import duckdb
import pytest

from textgauge.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op4_url_filters": "page_id host path rule verdict",
    "op5_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op6_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op9_toxicity": "doc_id held_out score predicted",
    "op11_source_divergence": "lang source part item value rank",
    "op12_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    out = duck.execute(queries.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns and set(COLUMNS[name].split()) <= set(columns)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def crc(value):
    return zlib.crc32(("" if value is None else str(value)).encode())


def test_sharding_law_and_cut_links(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_sharding(spark, SF).collect()
    assert set(COLUMNS["op1_sharding"].split()) <= set(rows[0].asDict()) and len(rows) == len(texts)
    held = [sorted(r.slot for r in rows if r.shard == k) for k in range(8)]
    assert max(map(len, held)) - min(map(len, held)) <= 1 and all(s == list(range(len(s))) for s in held)
    assert all((r.law, r.grown_shard, r.size, r.text_crc32) == ("rows", None, len((texts[r.doc_id] or "").encode()) + 1, crc(texts[r.doc_id])) for r in rows)

    def cut(shard):
        groups: dict = {}
        for i, t in texts.items():
            groups.setdefault(t, []).append(shard[i])
        # links of a chain through each group's documents, in the order of their shards
        return sum(len(set(g)) - 1 for g in groups.values())

    assert cut({r.doc_id: r.shard for r in rows}) < cut({i: crc(i) % 8 for i in texts})


@pytest.mark.parametrize("name,folds,kept", [("op2_language_id", 4, 2), ("op9_toxicity", 5, 0)])
def test_held_out(spark, name, folds, kept):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert set(COLUMNS[name].split()) <= set(rows[0].asDict())
    assert all(r.held_out == (crc(r.doc_id) % folds == kept) and 0 <= r.score <= 1 for r in rows)
    if name == "op9_toxicity":
        assert all(r.predicted == int(r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("name,table", [("op12_embedding_whitening", "embeddings"), ("op13_secret_scan", "documents")])
def test_columns_and_rows(spark, name, table):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert got.count() == n * (8 if table == "embeddings" else 1)
