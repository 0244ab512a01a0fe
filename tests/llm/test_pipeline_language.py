"""Texts in scripts that no tree has learned leave the pipeline whatever their length."""

import corpus_pipeline


def test_short_texts_of_unlearned_scripts_go(spark, sf):
    strange = ["Сегодня хорошая погода, мы идём.", "今天天气很好，我们去散步，然后回家。", "今日はとても天気がいい", "Сегодня хорошая погода, и мы идём гулять в парк вместе с друзьями."]
    plain = ["a", "zwei Wörter", "Some words here and more", "é ß ́ 日本 ²"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = [(-1 - i, t, None, "s", 0) for i, t in enumerate(strange)] + [(-100 - i, t, None, "s", 0) for i, t in enumerate(plain)]
    out = corpus_pipeline.known_language(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), sf)
    assert sorted(r["doc_id"] for r in out.where("doc_id < 0").collect()) == [-103, -102, -101, -100]
    assert out.where("doc_id >= 0").count() == docs.where("text RLIKE '[A-Za-z]'").count()
