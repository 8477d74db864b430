import math

import duckdb
import pytest

from textgauge import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 8)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in queries.SQL:
        out = duck.execute(queries.SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)


def test_wer_report_scores_every_document(spark):
    jobs, responses, targets = queries.evaluation_inputs(spark, SF)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert jobs.count() == docs.count() and responses.count() == docs.where("text IS NOT NULL").count()
    assert targets.select("verbatim").distinct().count() == items.select("text").distinct().count()
    report = queries.reports.wer_report(jobs, responses, targets, most=1)
    scored = report["cases"].select("profile", "case_id").distinct().count()
    assert scored + report["unscored"].count() == docs.count()
    assert scored >= 0.95 * docs.count()
    assert queries.wer_report(spark, SF).where("level = 'by_n'").agg({"scored_videos": "max"}).first()[0] == scored


def test_leak_check_keeps_every_document_and_item(spark, tmp_path):
    spark.createDataFrame([(k, f"Start {k} here. one w{k}w two three four") for k in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, "says Start 59 here today"), (41, None), (99, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_items, r.leaks) for r in queries.leak_check(spark, str(tmp_path)).collect()}
    assert got == {0: (1, True), 41: (0, False), 99: (0, False)}
