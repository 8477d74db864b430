import random

import corpus_pipeline
from textgauge.llm.contamination import strip_spans
from textgauge.llm.mixing import mix

PARTS = {"aa": "the of and ing er on".split(), "bb": "el la de ción es".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    bench = [(i, prose(rng, "aa", 25)) for i in range(3)]
    rows, toxic = [], set()
    for i in range(400):
        lang = rng.choices(["aa", "bb"], [4, 1])[0]
        w = prose(rng, lang, rng.randint(20, 80)).split()
        if rng.random() < 0.1:
            toxic.add(i)
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zork" if lang == "aa" else "plixa")
        rows.append((i, " ".join(w), lang, "s", len(" ".join(w))))
    clean = [r for r in rows if r[0] not in toxic]
    rows += [(500 + k, clean[k][1] + " end", clean[k][2], "s", 1) for k in range(20)]
    rows += [(600, clean[30][1] + " " + bench[1][1], "aa", "s", 1), (700, None, None, None, None), (701, "", None, "s", 0), (None, clean[40][1], "aa", "s", 5), (clean[41][0], *clean[41][1:])]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = docs.collect()
    ids = {n: [r.doc_id for r in v] for n, v in kept.items()}
    assert not toxic & set(ids["toxicity"]) and len(ids["toxicity"]) >= len(rows) - len(toxic) - 2
    near = ids["ngram_jaccard_join"]
    assert len(set(near)) == len(near) and not set(range(500, 520)) & set(near) and {600, 700, 701, None} <= set(near)
    cut = {r.doc_id: r for r in kept["benchmark_decontamination"]}
    assert sorted(cut, key=str) == sorted(near, key=str)
    assert cut[600].text.strip() == clean[30][1] and cut[600].n_chars == len(cut[600].text)
    assert cut[700].text is None
    assert set(ids["source_mixing"]) == set(near) and len(ids["source_mixing"]) > len(near)
    assert len(kept["sharding"]) == len(ids["source_mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["sharding"])


def test_stages_on_empty_table(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], names)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_mix_keeps_other_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x", 9), (2, None, None, 9)], "doc_id long, text string, lang string, rate int")
    assert mix(d, d.selectExpr("text", "lang domain")).columns == d.columns
    assert strip_spans(d, spark.createDataFrame([], "item_id long, text string")).collect() == d.collect()
