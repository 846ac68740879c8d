import random

import numpy as np
import pyarrow as pa
from test_operators import brute_components, near_cases, shingle_set

from lectern.llm import near_dedup


def kept_ids(texts, similarity):
    """Ids that are the least of their component, by comparing all pairs."""
    sets, least = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= similarity * (len(a) + len(sets[j]) - common):
                x, y = sorted((least[i], least[j]))
                least = [x if c == y else c for c in least]
    return [i for i, c in enumerate(least) if c == i]


def borderline():
    """300 pairs with 80 of 100 shingles in common."""
    draw = random.Random(11)
    texts = []
    for n in range(300):
        words = [f"w{draw.randrange(10**6)}" for _ in range(94)]
        texts += [" ".join(words), " ".join(words[:84] + [f"t{n}x{k}" for k in range(10)])]
    return texts


def test_the_similarity_asked_for_holds(docs_of):
    texts = near_cases() + borderline()[:20]
    rows = near_dedup.keep_one(docs_of(texts), 80).collect()
    assert sorted(r.doc_id for r in rows) == kept_ids(texts, 80) != kept_ids(texts, 85)


def test_pairs_at_the_limit_are_linked(docs_of):
    docs = docs_of(borderline())
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs, 80).collect()) == list(range(0, 600, 2))
    assert near_dedup.keep_one(docs, 81).count() == 600


def test_few_equal_places_reach_the_full_sets():
    assert [near_dedup.least_equal(k) for k in (80, 85)] == [71, 79]
    x, y = np.zeros(near_dedup.HASHES, np.uint32), np.zeros(near_dedup.HASHES, np.uint32)
    y[79:] = 1
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "x": [x.tobytes()], "y": [y.tobytes()]})
    assert near_dedup._alike(near_dedup.least_equal(85), batch) == {"a": [1], "b": [2]}


def families():
    """Near copies of one text with 0 to 7 words changed (similarities from 0.4 up), of copies of it, and texts with a passage in common."""
    draw = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    other = base[:60] + [f"o{i}" for i in range(90)]
    texts = []
    for n in range(260):
        words = list(base if n % 3 else other)
        for _ in range(draw.randrange(8)):
            words[draw.randrange(150)] = f"n{draw.randrange(40)}"
        texts.append(" ".join(words))
    for n in range(60):
        texts.append(" ".join(base[20:80] + [f"p{n}x{draw.randrange(1000)}" for _ in range(draw.randrange(5, 80))]))
    draw.shuffle(texts)
    return texts


def test_hot_families_equal_brute_force(docs_of):
    texts = families()
    for similarity in (80, 85):
        rows = near_dedup.near_duplicates(docs_of(texts), similarity).collect()
        expected = brute_components(dict(enumerate(texts)), similarity)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == expected
        assert 1 < len({c for _, c, _ in expected.values()}) < len(texts) - 50
