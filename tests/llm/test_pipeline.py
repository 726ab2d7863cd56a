"""Every stage of the pipeline on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).persist()
        done[name] = docs, out
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    before, after = done["near_duplicates"]
    assert after.select("doc_id").distinct().count() == after.count() <= before.count()
    before, after = done["personal_data"]
    assert after.count() == before.count() and after.where(F.col("text").rlike(r"[a-z]@[a-z0-9-]+\.[a-z]")).count() == 0
    before, after = done["packing"]
    assert after.groupBy("doc_id", "doc_tokens").count().select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_clashing_names_and_repeated_ids(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    more = {c: F.lit(k) for k, c in enumerate(("score", "_key", "domain", "epoch", "id", "group", "own_id", "_domain", "digest", "bands", "n", "Text_Key"))}
    a, b = "alpha beta gamma delta epsilon zeta eta", "some other words that are not like these at all"
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1), (None, a, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, kind).withColumns(more)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert {(r.score, r._key, r.domain) for r in out.collect()} == {(0, 1, 2)}
        if name == "near_duplicates":
            assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("1", a), ("1", b), ("None", a), ("2", "None"), ("3", "")])
    assert corpus_pipeline.pack(spark, docs, sf).agg(F.count_if(F.col("start") == 0)).first()[0] == len(rows)


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
