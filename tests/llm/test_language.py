import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import language_id

SYLLABLES = {"aa": "ba be bi bo bu", "bb": "kra kre kri kro", "cc": "ño ña lli rre", "rare": "xu xo zu zo"}


def made_up(count, seed):
    draw, rows = random.Random(seed), []
    for i in range(count):
        lang = draw.choice(("aa", "bb", "cc")) if i % 100 else "rare"
        words = ["".join(draw.choices(SYLLABLES[lang].split(), k=draw.randrange(2, 5))) for _ in range(draw.randrange(5, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_up(3000, 1), "doc_id long, text string, lang string")


def test_rare_languages_are_learned(docs):
    model = language_id.train(docs, rows=60)
    assert sorted(set(model.langs)) == ["aa", "bb", "cc", "rare"]
    rows = language_id.predict(docs, model).join(docs, "doc_id").filter(language_id.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98 and all(r.lang_pred == "rare" for r in rows if r.lang == "rare")


def test_far_texts_are_rejected(spark, docs):
    model = language_id.train(docs)
    odd = spark.createDataFrame([(i, "qwyj vvkw " * 20) for i in range(5)] + [(10, "babe bibo bu")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all(rows[i].rejected and rows[i].score < 0.3 for i in range(5)) and rows[10].lang_pred == "aa"


def test_repeated_rows_and_other_columns_change_nothing(docs):
    model = language_id.train(docs, rows=200)
    again = language_id.train(docs.unionByName(docs).unionByName(docs.filter("doc_id < 50")).withColumn("source", F.lit("aa")).repartition(3), rows=200)
    assert again.langs == model.langs
    some = docs.limit(30).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9))
    out = language_id.predict(some.unionByName(some), model).collect()
    assert len(out) == 60 and len({(r.doc_id, r.lang_pred, r.score) for r in out}) == 30


def test_held_out_rows_teach_nothing(docs):
    lied = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("lie")).otherwise(F.col("lang")))
    assert "lie" not in language_id.train(lied).langs


def test_nothing_to_learn_from(spark, docs):
    empty = docs.limit(0)
    model = language_id.train(empty)
    assert language_id.predict(empty, model).collect() == []
    bare = spark.createDataFrame([(1, "some text", None), (2, None, "aa"), (None, "", "bb")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.predict(bare, language_id.train(bare)).collect()} == {("und", 0.0)}
