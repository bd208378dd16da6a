import math
import re
from collections import Counter

import numpy as np
import pytest

from skerry.llm import queries, tiers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """item, rank, doc, score by the contract's formula over all pairs."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, c), n in zip(counts, sizes, strict=True):
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
            if score > 0:
                scores.append((-score, 2**63 - 1 if doc is None else doc))
        out += [(item, r + 1, None if d == 2**63 - 1 else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    vocabulary = [f"W{i}" if i % 3 else f"ñ{i}é" for i in range(1500)]
    weight = 1 / np.arange(1, 1501)
    draw = lambda size: [vocabulary[i] for i in rng.choice(1500, size, p=weight / weight.sum())]
    docs = [(int(i), " ".join(draw(int(rng.integers(0, 150))))) for i in rng.permutation(n)]
    items = []
    for i in range(40):
        own = draw(int(rng.integers(3, 25)))
        items.append((i, ", ".join(own)))
        if i % 2:  # passages that stand in many documents
            for at in rng.integers(0, n, 14):
                docs[at] = (docs[at][0], docs[at][1] + ". " + " ".join(own))
    docs += [(n, None), (n + 1, ""), (n + 2, "--- !!"), (n + 3, items[1][1]), (n + 3, items[1][1]), (None, items[1][1]), (n + 4, "w1 " * 30000)]
    items += [(100, None), (101, "..."), (102, "nowhere"), (3, items[3][1]), (None, "w1 w2 W2")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("cuts", "block"), [(((20, 8), (60, 3)), 1 << 20), (((1024, 64), (16384, 8)), 100), (((1, 500), (3, 100)), 1 << 20)])
def test_best_documents_against_brute_force(spark, monkeypatch, cuts, block):
    monkeypatch.setattr(tiers, "TIERS", cuts)
    monkeypatch.setattr(tiers, "BLOCK", block)
    monkeypatch.setattr(tiers, "CELLS", 4000)
    docs, items = corpus(3)
    log = []
    found = tiers.search(*frames(spark, docs, items), log=log).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(docs, items)
    if cuts[0][0] == 20:  # items are proven by each tier, and others come to the next
        assert [proven > 0 for _, proven in log] == [True] * 3 and sum(proven for _, proven in log) == log[0][0]


def test_a_sample_that_misses_terms(spark, monkeypatch):
    monkeypatch.setattr(tiers, "SAMPLE", 5)
    monkeypatch.setattr(tiers, "TIERS", ((2, 64), (12, 8)))
    docs, items = corpus(9, 150)
    assert sorted((tuple(r) for r in tiers.search(*frames(spark, docs, items)).collect()), key=str) == brute(docs, items)


def test_sums_beyond_doubles(monkeypatch):
    import pyarrow as pa

    block = tiers.Block(pa.table({"iid": pa.array([7, 7, 9]), "term": pa.array([b"a", b"b", b"a"])}))
    block.search_for(np.ones(2, dtype=bool))
    big = 2**53 + 1
    got = block.sums(np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([big, 2, 5]), 2)
    assert got.tolist() == [[big + 2, big], [5, 5]]


def test_query_with_clashing_columns_and_empty_tables(spark, tmp_path):
    docs, items = corpus(4, 120)
    spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, row int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op13_tiered_search"](spark, str(tmp_path))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
    d, i = frames(spark, docs, items)
    assert tiers.search(d.limit(0), i).count() == tiers.search(d, i.limit(0)).count() == tiers.search(d.filter("text is null"), i).count() == 0
