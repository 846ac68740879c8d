import collections
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import packing, token_count, token_ids

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTE)
ODD = [
    "", " ", "  ", "a  b", " a", "a ", "x\n\ny", "x \n y", "x y  z", "it's we're they'd I'll 'tis ''s 'r 've", "ABC déjà ÉCOLE Straße İstanbul ΣΑΣ Σ",
    "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c <|endoftext", "école à ́x", "tab\tx\x0by\x0cz\r\n", "\x1c a\x1cb \x1f", "日本語 テスト 😀😀 🇩🇪", "123 45,678.90 1½ ²",
    "aaaa" * 300, " x　y z", "0123456789abcdef" * 5, "-- --- '' \"\" ...", "x\x00y", "a​b", "ﬁ ﬂ ǅ",
]


def corpus(n=300):
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '/root/testdata/sf0.001/documents.parquet' LIMIT {n}").fetchall()]


def ids(text):
    raw = token_ids.ids_bytes(BYTE)(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_ids_equal_the_librarys():
    library = Tokenizer.from_file(BYTE)
    for text in [*ODD, *corpus()]:
        assert ids(text) == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_counts_equal_the_librarys():
    library, machine = Tokenizer.from_file(WORD), token_count.Transducer(WORD)
    for text in [*ODD, *corpus()]:
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aB'sr\té é.,1 \n \x1cΣ<|endoftext|>")), max_size=40))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    machine = token_count.transducer(WORD)
    whole = machine.count(text)
    for chunk in (1, 3, 7):  # chunk maps compose to the same count
        assert machine.count(text, chunk) == whole


def test_states_beyond_the_limit_count_alike(monkeypatch):
    monkeypatch.setattr(token_count, "STATES", 10)
    monkeypatch.setattr(token_count, "WORDS", 3)
    a, b = token_count.Transducer(WORD), token_count.transducer(WORD)
    assert [a.count(t) for t in corpus(30)] == [b.count(t) for t in corpus(30)]


def test_count_tokens(spark, docs_of):
    docs = docs_of([None, "", "é", "word " * 3000]).withColumnRenamed("lang", "n_tokens")  # a clashing name
    rows = {r.doc_id: r for r in token_count.count_tokens(docs, WORD).collect()}
    assert [(rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) for i in range(4)] == [(0, 0, False), (0, 0, False), (2, 1, False), (15000, 3000, True)]
    assert token_count.count_tokens(docs.limit(0), WORD).collect() == []


def test_closest_fill_is_the_best_sum():
    import itertools
    import random

    draw = random.Random(3)
    for _ in range(200):
        items = [draw.randint(1, 30) for _ in range(draw.randint(1, 7))]
        counts, capacity = collections.Counter(items), draw.randint(0, 60)
        used = packing.closest_fill(sorted(counts), counts, capacity)
        assert all(n <= counts[k] for k, n in used.items())
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= capacity)
        assert sum(k * n for k, n in used.items()) == best


def check_pieces(rows, texts, window=packing.WINDOW):
    library = Tokenizer.from_file(BYTE)
    whole = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(whole)
    for i, pieces in by.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole[i])
            part = whole[i][at : at + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(whole[i])
    padding = 0
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(map(len, whole.values()))


@pytest.mark.parametrize("block", [20_000, packing.BLOCK_TOKENS])
def test_pack(spark, docs_of, monkeypatch, block):
    texts = dict(enumerate([None, "", "one two", "three " * 9000, *corpus(150)]))
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    rows = packing.pack(docs_of(list(texts.values())).coalesce(1), BYTE).collect()
    padding, tokens = check_pieces(rows, texts)
    assert padding <= 2048 * (1 + tokens // block) and padding < 0.05 * tokens


def test_pack_of_nothing(docs_of):
    assert packing.pack(docs_of(["a"]).limit(0), BYTE).collect() == []


def test_fill_patterns_use_up_all_counts():
    counts = {1000: 5, 1048: 3, 24: 7, 2047: 2, 1: 1, 700: 1000}
    total = collections.Counter()
    patterns = list(packing.fill_patterns(counts))
    for used, times in patterns:
        assert sum(k * n for k, n in used.items()) <= packing.WINDOW
        for k, n in used.items():
            total[k] += n * times
    assert total == counts and len(patterns) < 30


def test_counts_of_made_up_words_equal_the_librarys():
    import random

    library, machine, draw = Tokenizer.from_file(WORD), token_count.transducer(WORD), random.Random(6)
    tokens = sorted(t.removesuffix("</w>") for t in machine.merges.tokens if t.isascii())
    for i in range(6000):
        text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz'!.-\u00e90 \u00f1\u65e5", k=draw.randrange(1, 26)) if i % 2 else draw.choices(tokens, k=draw.randrange(1, 7)))
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_chunk_maps_compose_in_any_grouping():
    machine = token_count.transducer(WORD)
    text = machine.normalised("One don't'll stop. " + "x" * 50 + "\u65e5\u672c 12ab'rest " * 3)
    whole = machine.chunk(text).at(machine.start)
    for size in (1, 2, 5, 11):
        maps = [machine.chunk(text[i : i + size]) for i in range(0, len(text), size)]
        left = maps[0]
        for m in maps[1:]:
            left = left.then(m)
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = m.then(right)
        for found in (left, right, machine.scan(maps)):
            state, total = found.at(machine.start)
            assert state is whole[0] and total == whole[1]
    # a chunk's map holds for any state before it
    for before in ("ab", "'", "12", "!?"):
        state, total = machine.walk(before)
        after, more = machine.chunk(text).at(state)
        assert total + more + after.last == machine.count(before + text)


def test_transitions_carry_the_counts():
    machine = token_count.Transducer(WORD)
    for text in ("hello", "don't", "it'll", "3.14!", "a-b"):
        state, total, path = machine.start, 0, []
        for c in text:
            state, n = state[c]
            total += n
            path.append(n)
        assert total + state.last == len(LIBRARY_WORD.encode(text, add_special_tokens=False).ids) and len(path) == len(text)
    assert machine.step(machine.start, " ") == (machine.start, 0)


LIBRARY_WORD = Tokenizer.from_file(WORD)


def test_no_padding_in_any_partitioning(spark, docs_of):
    texts = dict(enumerate([None, "", "one two", "three " * 5000, *corpus(150)]))
    for parts in (1, 7, 200):
        docs = docs_of(list(texts.values())).withColumn("start", F.lit("x")).withColumn("OFFSET", F.lit(1)).repartition(parts)
        rows = packing.pack(docs, BYTE).collect()
        assert check_pieces(rows, texts)[0] == 0 and len({r.sequence_id for r in rows}) < len(rows)


def test_repeated_rows_are_packed_as_often(docs_of):
    docs = docs_of(["one two three", "word " * 2500])
    rows = packing.pack(docs.unionByName(docs).coalesce(1), BYTE).collect()
    covered = collections.Counter((r.doc_id, p) for r in rows for p in range(r.start, r.start + r.length))
    assert set(covered.values()) == {2} and {r.doc_tokens for r in rows if r.doc_id == 0} == {4}
