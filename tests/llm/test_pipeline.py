import corpus_pipeline
from conftest_rows import SCHEMA, plain

from vaultloom.llm import secrets
from vaultloom.llm.common import table


def test_stages_take_effect(spark, tmp_path):
    leak = plain(30, seed=500)
    rows = [(k, plain(40, lang, k), lang, "s", 1) for k in range(60) for lang in [("en", "de", "fr")[k % 3]]]
    rows += [(100, rows[0][1], "en", "s", 1), (101, plain(20, seed=1) + " " + leak + " " + plain(20, seed=2), "en", "s", 1), (102, "123 !!", "en", "s", 1), (103, None, "en", "s", None), (104, plain(30, seed=77) + " password=abcdefgh123", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = {r[0] for r in rows}
    assert kept[0] == every - {102, 103}
    assert kept[1] == kept[0] - {100}
    assert kept[2] == kept[1] - {101}
    assert kept[3] == kept[2] == kept[4]
    masked = spark.read.parquet(f"{tmp_path}/secrets").where("doc_id = 104").first()
    assert masked["text"].endswith(" [secret]") and masked["n_chars"] == len(masked["text"])
    assert secrets.found(spark.read.parquet(f"{tmp_path}/secrets")).where("size(spans) > 0").count() == 0
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in run.select("doc_id").distinct().collect()} == kept[4]


def test_odd_rows(spark, tmp_path, odd):
    """Nulls in any column, empty and very long texts, repeated rows and extra columns with clashing names, stage by stage."""
    import pyspark.sql.functions as F

    others = spark.createDataFrame([(1000 + k, plain(40, lang, 1000 + k), lang, "s", 1) for k in range(90) for lang in [("en", "de", "fr")[k % 3]]], SCHEMA)
    docs = odd.unionByName(odd.where("doc_id = 7")).unionByName(others).withColumn("_row", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("score", F.lit(None).cast("double")).withColumn("item_id", F.lit(2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, plain(50, seed=9)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, columns = table(spark, str(tmp_path), "documents"), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns and now.count() <= before.count()
        kept = [(r["doc_id"], len(r["text"] or "")) for r in now.select("doc_id", "text").collect()]
        if name == "language":
            assert all(d not in (1, 2, 3, 10) for d, _ in kept) and {6, 7, 9} <= {d for d, _ in kept}
        if name == "near_duplicates":
            assert sum(d in (7, 8) for d, _ in kept) == 1 and (6, len(plain(30_000, seed=6))) in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_empty_table(spark, tmp_path, none):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark, sf):
    """At the smallest scale the language stage still knows its languages."""
    docs = table(spark, sf, "documents")
    kept = corpus_pipeline.language(spark, docs, sf).select("doc_id").collect()
    assert len(kept) >= 0.97 * docs.count()
