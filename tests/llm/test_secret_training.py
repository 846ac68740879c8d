import numpy as np

from lectern.llm import secret_scan


def test_all_documents_train_the_ordinary_model(docs_of):
    texts = ["alpha beta gamma"] * 4999 + ["zqx vkj wqz"]
    samples = secret_scan.training_samples(docs_of(texts)).filter("random = 0")
    assert samples.count() == 5000
    assert samples.filter("lower(token) LIKE '%zqx%'").count() == 1


def test_counts_of_a_batch_equal_those_token_by_token(spark):
    rows = [("abc", 0), ("c", 0), ("", 0), (None, 1), ("a+\u00e9\U0001d400b", 1), ("Zz9", 1), ("ca", 0)]
    counts = np.full((2, secret_scan.N, secret_scan.N), 0.05)
    for token, label in rows:
        if token:
            np.add.at(counts[label], secret_scan.transitions(token), 1)
    p = np.log(counts / counts.sum(axis=2, keepdims=True))
    assert np.array_equal(secret_scan.train(spark.createDataFrame(rows, "token string, random int")), p[1] - p[0])
