import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from test_operators import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import packing, queries, secret_scan, toxicity
from lectern.llm.common import table

SF = "/root/testdata/sf0.001"


def plainly(spark):
    """{doc_id: (text, copies)} after all stages but packing, each done in plain Python or SQL on the one before."""
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    rows = [r for r in docs.collect() if model.score(r.text) < queries.TOXIC_FROM]
    component = brute_components({r.doc_id: r.text for r in rows}, 80)  # what filtering stages take unless a contract says otherwise
    rows = [r for r in rows if component[r.doc_id][2]]
    ratios = secret_scan.train(secret_scan.training_samples(spark.createDataFrame(rows, docs.schema)))
    texts = {r.doc_id: None if r.text is None else secret_scan.redact_text(r.text, ratios, "[SECRET]") for r in rows}
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, texts[r.doc_id], r.source) for r in rows])
        copies = Counter(x[0] for x in db.execute(queries.MIXING_SQL).fetchall())
    return {i: (t, copies[i]) for i, t in texts.items()}


@pytest.fixture(scope="module")
def expected(spark):
    return plainly(spark)


def test_run_equals_the_stages_done_plainly(spark, expected):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, (t, _) in expected.items()}
    assert {r.doc_id for r in rows} == set(expected)
    covered, sequences = {i: Counter() for i in ids}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        covered[r.doc_id].update(range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, (_, copies) in expected.items():
        assert copies >= 1 and covered[i] == Counter({p: copies for p in range(len(ids[i]))})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names and 0 < out.count()


def test_the_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
