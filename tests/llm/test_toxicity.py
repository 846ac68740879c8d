import random
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import toxicity

PLACES = "library bridge station market garden school river museum bakery harbour".split()
INSULTS = "filthy vermin scum disgusting worthless".split()
TERMS = [t for g in toxicity.IDENTITY_GROUPS for t in g]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def biased(spark):
    """Labelled texts of which the toxic ones mention groups far more often than the clean ones."""
    draw, rows = random.Random(3), []
    for i in range(1600):
        toxic, place = i % 4 == 0, draw.choice(PLACES)
        who = draw.choice(TERMS) if draw.random() < (0.8 if toxic else 0.05) else "".join(draw.choices("abcdefghij", k=9))
        text = f"We walked to the {place} and the {draw.choice(PLACES)} today. The {who} of the town were there. It rained near the {draw.choice(PLACES)}. "
        # half of the toxic texts hold no word that tells them from clean ones but the mention
        last = draw.choice(INSULTS) if toxic and draw.random() < 0.5 else draw.choice(("kind", "busy", "quiet"))
        text += f"They are {last} people."
        rows.append((i, text, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def neutral_flagged(model):
    texts = [f"The {t} of the town opened a {p}. They are kind people." for t in TERMS for p in PLACES]
    return sum(model.score(t) >= 0.3 for t in texts) / len(texts)


def test_neutral_mentions_are_left_alone(biased):
    plain, model = toxicity.train(*biased, strength=0.0), toxicity.train(*biased)
    assert neutral_flagged(plain) > 0.5 and neutral_flagged(model) < 0.05
    assert all(model.score(f"The {t} are {x} people.") >= 0.3 for t in TERMS[:8] for x in INSULTS)


def test_neutral_mentions_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert neutral_flagged(model) == 0
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").filter(toxicity.held_out()).select("text").limit(40).collect()]
    for text in clean:
        for term in TERMS[::5]:
            assert (model.score(f"{text} The {term} came.") >= 0.3) == (model.score(text) >= 0.3)


def test_a_swap_rewrites_the_sentence():
    pairs = toxicity.counterfactuals("Rain again. Two women and a blind man met. Sun.")
    assert len(pairs) == 4 and all(a == " two women and a blind man met." for a, _ in pairs)
    assert [("women" in b, "blind" in b) for _, b in pairs] == [(True, False)] * 2 + [(False, True)] * 2
    assert sum(toxicity.NEUTRAL in b for _, b in pairs) == 2
    assert len(toxicity.counterfactuals("The women met. " * 30)) <= toxicity.PAIRS_PER_TEXT
    (plain, one), (first, other) = toxicity.counterfactuals("Rain again. Sun.")
    assert first == one and one != other and len(one.split()) == len(plain.split()) + 2
    assert toxicity.counterfactuals(None) == toxicity.counterfactuals("12 ?!") == []


def test_repeated_rows_and_clashing_names_change_nothing(biased):
    docs, labels = biased
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.unionByName(docs).withColumn("toxic", F.lit(7)).repartition(7), labels.unionByName(labels))
    assert again.weights == model.weights and again.bias == model.bias
    odd = docs.limit(20).withColumn("toxic", F.lit("x")).withColumn("TOXIC_", F.lit(1))
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.filter("toxic <> 'x'").isEmpty()
    assert toxicity.keep_clean(odd.limit(0), model).collect() == []
    assert toxicity.score(odd.unionByName(odd), model).count() == 40


def test_held_out_rows_teach_nothing(biased):
    docs, labels = biased
    lied = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, lied).weights == toxicity.train(docs, labels).weights
    assert {r.doc_id for r in labels.filter(toxicity.held_out()).collect()} == {i for i in range(1600) if held_out(i)}
