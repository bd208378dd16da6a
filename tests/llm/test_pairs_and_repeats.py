import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import jaccard, licenses, mixture, queries, repeats

DOCS = "doc_id long, text string, lang string, source string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1") for i, t in texts], DOCS)


def words(seed, n, vocabulary=5000):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n)]


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute_components(texts, k, percent):
    sets = [(i, shingles(t, k)) for i, t in texts]
    up = {i: i for i, _ in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in texts}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_against_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    texts, n = [], 0
    for group in range(6):
        origin = words(group, 120)
        for copy in range(12):
            own = list(origin)
            for at in rng.integers(0, len(own), copy // 2):
                own[at] = f"edit{n}_{at}"
            texts.append((n * 7 % 101, " ".join(own)))
            n += 1
    texts += [(200, "one two"), (201, "ONE two"), (202, ""), (203, "solo"), (204, "   "), (205, " ".join(words(0, 120)))]
    found = {r["oid"]: r for r in jaccard.Join(frame(spark, texts), width=k, percent=percent).members().collect()}
    want = brute_components(texts, k, percent)
    assert {i: r["component"] for i, r in found.items()} == want
    assert {i: r["n"] for i, r in found.items()} == {i: len(shingles(t, k)) for i, t in texts}


def test_components_edge_cases(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (None, "a b c d e"), (3, "x " * 3000), (4, "X " * 2000)]
    found = jaccard.Join(frame(spark, rows)).members().collect()
    assert len(found) == len(rows)
    assert sorted(r["component"] for r in found) == [1, 1, 1, 2, 3, 3]
    assert jaccard.Join(frame(spark, [])).members().count() == 0
    kept = jaccard.keep_first(frame(spark, rows).withColumn("comp", F.lit("clash")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3] and kept.columns[-1] == "comp"


@pytest.mark.parametrize("most", [0, 500_000])
def test_a_set_in_many_pairs(spark, most, monkeypatch):
    """Pairs travel as rows: what is broadcast has no lists, so its size is that of its rows; without any broadcast links are the same."""
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
    sent = []
    small = jaccard._small
    monkeypatch.setattr(jaccard, "_small", lambda rows: sent.append(rows) or small(rows))
    origin = words(1, 200)
    texts = [(i, " ".join(origin[:i] + [f"own{i}"] + origin[i + 1 :])) for i in range(150)] + [(200 + i, " ".join(words(50 + i, 60))) for i in range(20)]
    found = {r["oid"]: r["n_links"] for r in jaccard.Join(frame(spark, texts)).members(counted=True).collect()}
    sets = {i: shingles(t, 4) for i, t in texts}
    want = {i: sum(100 * len(s & t) >= 85 * len(s | t) for j, t in sets.items() if j != i) for i, s in sets.items()}
    assert found == want and max(want.values()) > 100
    assert sent and not any(kind.startswith("array") for rows in sent for _, kind in rows.dtypes)
    assert max(rows.count() for rows in sent) > 100


def brute_repeats(texts, length):
    first = {}
    split = {i: (t or "").split() for i, t in texts}
    for i, w in split.items():
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone.update(range(p, p + length))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_repeats_against_brute_force(spark):
    passage, other = words(1, 130), words(2, 60)
    texts = [
        (5, " ".join(words(3, 200) + passage)), (2, " ".join(words(4, 90) + passage[10:] + words(5, 90))), (9, " ".join(passage[:49])),
        (7, " ".join(other + passage[20:80] + other)), (8, " ".join(other)), (11, "  ".join(other)), (12, ""), (13, "the " * 300), (14, "the " * 200)
    ]
    assert repeats.Repeats(frame(spark, texts)).meta.count() == len(texts)
    found = {r["doc_id"]: r["text"] for r in repeats.remove(frame(spark, texts)).collect()}
    want = brute_repeats(texts, 50)
    assert {i: t.split() for i, t in found.items()} == want
    assert found[9] == texts[2][1]  # what loses nothing stays as it is
    longest = {r["oid"]: r["longest"] for r in repeats.longest(frame(spark, texts)).collect()}
    assert longest[5] == 100 and longest[14] == 200


def test_repeats_edge_cases(spark):
    same = " ".join(words(8, 70))
    rows = [(1, same), (1, same), (2, same.replace(" ", "\n")), (None, same), (3, None)]
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else 99), r["text"]) for r in repeats.remove(frame(spark, rows)).collect() if r["doc_id"] != 3)
    assert [t for _, t in found] == [same, same, "", ""]
    assert repeats.remove(frame(spark, [])).count() == 0


def test_anchors_of_a_text_beyond_24_bits_of_positions():
    """No repeated window is missed however far into a text it stands."""
    n = (1 << 24) + 2000
    hashes = np.random.default_rng(5).integers(0, 2**63, n, dtype=np.uint64)
    passage = hashes[-600:-500]
    h, p = repeats.anchors(hashes, 50)
    assert p[-1] > 1 << 24 and set(repeats.anchors(passage, 50)[0].tolist()) <= set(h.tolist())
    near = p[p >= n - 600]
    assert set(range(n - 600, n - 500 - 49)) <= set(repeats.starts_of(hashes, 50, near).tolist())


def test_columns_that_look_like_ours(spark):
    """Columns of any name come back as they were."""
    same = " ".join(words(8, 70))
    rows = [(1, same, "en", "s"), (2, same, "en", "s"), (3, "short", "en", "s"), (3, "short", "en", "s"), (3, "short", "de", "s")]
    extra = {c: F.col("doc_id") + 70 for c in (
        "_a", "_b", "_oid", "_th", "_n", "_first", "_starts", "_mark", "_row", "_id", "_h", "_own", "_epoch", "_take", "component"
    )}
    docs = spark.createDataFrame(rows, DOCS).withColumns(extra)
    for made in (repeats.remove(docs), jaccard.keep_first(docs), mixture.select(docs, share_percent=100)):
        assert made.columns == docs.columns
        found = made.collect()
        assert found and all(r[c] == r["doc_id"] + 70 for r in found for c in extra)
    kept = [sorted((r["doc_id"], r["lang"]) for r in jaccard.keep_first(own).collect()) for own in (docs, docs.repartition(3, "lang"))]
    assert [i for i, _ in kept[0]] == [1, 3] and kept[0] == kept[1]


def test_license_scan(spark):
    mit = licenses.TEMPLATES[1][1]
    long = mit.split()
    texts = [
        (1, "Released under the MIT License."), (2, None), (3, "nothing"), (4, "x " * 30 + mit.upper() + " y" * 30),
        (5, " ".join(long[:8] + ["extra"] + long[8:])), (6, "mit\nLicense, Apache license; general PUBLIC license"), (7, "mit license " * 500),
        (8, " ".join(long[:9] + long[11:]))
    ]
    found = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert found[1]["labels"] == "mit" and found[1]["n_base"] == 1 and found[1]["first_word"] == 3 and found[1]["score"] == 1.0
    assert (found[2]["n_words"], found[2]["labels"], found[2]["first_word"], found[2]["score"]) == (0, "", None, 0.0)
    assert found[4]["labels"] == "mit" and found[4]["base_labels"] == "" and found[4]["score"] == 1.0
    assert found[5]["labels"] == "mit" and found[5]["score"] == 1.0  # a word more: both diagonals make one band
    assert found[8]["labels"] == "mit" and found[8]["score"] == (len(long) - 2) / len(long)
    assert found[6]["base_labels"] == "apache,gpl,mit" and found[6]["last_word"] == 4
    assert found[7]["n_base"] == 500 and found[7]["last_word"] == 998
    assert licenses.scan(frame(spark, [])).count() == 0


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("domain0", "en", "a", 100), ("domain0", "en", "b", 1000), ("domain0", "fr", "c", 1000), ("domain1", "en", "d", 1000)],
        "domain string, lang string, source string, tokens long"
    )
    found = {r["source"]: r["budget"] for r in mixture.budgets(
        leaves, weights={"domain": {"domain0": 50, "domain1": 50}, "lang": {"en": 50, "fr": 50}}, share_percent=50, epochs=1
    ).collect()}
    # 1550 tokens: 775 each domain; domain0's 388 and 387 by language; `a` holds 100, the rest of its share goes to `b`.
    assert found["d"] == 775 and found["c"] == 387 and found["a"] == 100 and found["b"] == 287


def test_mixture_selects_whole_budgets(spark):
    rows = [(i, " ".join(words(i, 5 + i % 40)), ("en", "de", None)[i % 3], f"src{i % 5}") for i in range(300)] + [
        (900, None, "en", "src1"), (901, "", "en", None), (7, " ".join(words(7, 12)), "de", "src2")
    ]
    docs = spark.createDataFrame(rows, DOCS)
    chosen = mixture.choose(docs).collect()
    total = sum(len(t.split()) for _, t, *_ in rows if t)
    taken = sum(r["take_tokens"] for r in chosen)
    assert 0.6 * total - 60 <= taken <= 0.6 * total
    assert all(0 < r["take_tokens"] <= r["n_tokens"] and r["epoch"] < mixture.MAX_EPOCHS for r in chosen)
    kept = mixture.select(docs.withColumn("epoch", F.lit("clash"))).collect()
    assert sum(len(r["text"].split()) for r in kept) == taken
    original = {i: t for i, t, *_ in rows}
    assert all(original[r["doc_id"]].startswith(re.sub(r"\s+$", "", r["text"])) or r["doc_id"] == 7 for r in kept)
    assert mixture.choose(docs.limit(0)).count() == 0


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_link_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 3)
    rng = np.random.default_rng(1)
    texts = []
    for k in range(40):
        own = words(k % 2, 120)
        for at in rng.integers(0, len(own), k // 12):
            own[at] = f"edit{k}_{at}"
        texts.append((k, " ".join(own)))
    texts += [(50, "one two"), (51, "ONE two"), (52, ""), (53, None), (54, "solo")]
    found = {r["oid"]: (r["component"], r["n_links"]) for r in jaccard.Join(frame(spark, texts)).members(counted=True).collect()}
    sets, comps = {i: shingles(t, 4) for i, t in texts}, brute_components(texts, 4, 85)
    linked = lambda s, t: bool(s and t) and 100 * len(s & t) >= 85 * len(s | t)
    assert found == {i: (comps[i], sum(linked(s, t) for j, t in sets.items() if j != i)) for i, s in sets.items()}
    inside = [n for c, n in found.values() if n]
    assert len(inside) > 20 and min(inside) < max(inside)


def test_license_query_with_repeated_rows_and_clashes(spark, tmp_path):
    rows = [
        (1, "under the MIT License", "en", "s"), (1, "under the MIT License", "en", "s"), (2, "x " * 30_000 + "apache license", "en", "s"),
        (None, "mit license", "en", "s"), (3, None, None, None)
    ]
    clash = {c: F.lit("clash") for c in ("words", "h", "label", "cover", "own", "best", "base", "n_words", "labels", "score")}
    frame(spark, rows and [(i, t) for i, t, *_ in rows]).withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], r["n_words"]) for r in found) == [
        (0, "mit", 2), (1, "mit", 4), (1, "mit", 4), (2, "apache", 30_002), (3, "", 0)
    ]
    frame(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert queries.QUERIES["op5_license_scan"](spark, f"{tmp_path}/empty").count() == 0
