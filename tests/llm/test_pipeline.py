"""The pipeline's stages, each against what its operator decides, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from archivelake.llm import common, decontaminate, simhash, toxicity

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{DATA}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = {r[0] for r in docs.select("doc_id").collect()}, [r[0] for r in out.select("doc_id").collect()]
        columns = columns or docs.columns
        if name == "token_output":
            assert sorted(after) == sorted(r[0] for r in docs.select("doc_id").collect())
            break
        assert out.columns == columns
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert set(after) == {r[0] for r in toxicity.score(docs, model).filter("predicted = 0").select("doc_id").collect()}
        elif name == "simhash_near_dedup":
            assert set(after) == {r[0] for r in simhash.near_duplicates(docs).select("component_id").collect()} and len(after) == len(set(after))
        elif name == "decontamination":
            found = decontaminate.decontaminate(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert set(after) == {r[0] for r in found.filter("not contaminated").select("doc_id").collect()}
        else:
            assert set(after) <= before and max(after.count(i) for i in after) <= 3
        same = out.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").filter("not (text <=> t)")
        assert same.isEmpty()
        docs = out


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    rows.sort(key=lambda r: r["start"])
    assert rows and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, an empty table, and further columns with names that the operators use themselves."""
    names = ["score", "predicted", "copies", "rows", "_h", "component", "fp", "hits", "items", "contaminated", "draws", "h", "_text", "key", "part"]
    rows = [(i % 40 if i % 9 else None, [None, "", "one", "many words in this text " * (i % 7 + 1) + str(i)][i % 4], "en", None if i % 5 else "s", i, *range(len(names))) for i in range(120)]
    rows += rows[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for frame in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, DATA)
            assert name == "token_output" or out.columns == docs.columns
            n = out.count()
            assert n > 0 or frame is not docs
            assert name in ("source_mixing",) or n <= len(rows)
            if name == "simhash_near_dedup" and n:
                assert out.filter("score = 0 and part = 14").count() == n


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", dict(spark.conf.getAll)
    monkeypatch.setattr(common, "BATCH_BYTES", 10_000)
    docs = spark.createDataFrame([(i, f"{i} " * 400, "en", "s", 1) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    own = common.in_small_batches(docs.withColumn("id", F.monotonically_increasing_id()))
    sizes = own.filter("id >= 0").mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1).set_column(0, "doc_id", [len(b)]) for b in batches), "doc_id long").collect()
    assert max(r[0] for r in sizes) <= 20 and sum(r[0] for r in sizes) == 200
    for name, stage in corpus_pipeline.STAGES:
        if name != "source_mixing":
            assert stage(spark, docs, DATA).sparkSession.conf.get(key) == "10000", name
    assert dict(spark.conf.getAll) == before and docs.sparkSession is spark


def test_training_features_never_come_to_the_driver_at_once(spark, monkeypatch):
    from pyspark.sql import classic

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    frame = classic.dataframe.DataFrame
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collect(self) if "f" not in self.columns else pytest.fail("all features at once"))
    assert -30 < toxicity.train(docs, labels).bias < 0
