import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import periodic, queries


def brute(words, least, times):
    """All runs by definition: for each period the stretches that have it; the smallest period of each stretch counts."""
    seen, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda x: (x[0], x[2]))


parts = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=7)


@settings(max_examples=600, deadline=None)
@given(parts)
def test_runs_against_brute_force(units):
    own = [x for unit, times in units for x in unit * times]
    codes = np.array(own, dtype=np.int64)
    for least, times in ((1, 2), (6, 3), (24, 3)):
        assert periodic.runs_of(codes, least, times) == brute(own, least, times)
        if times == 3:
            assert periodic.runs_of_words([b"w%d" % x for x in own], least, times) == brute(own, least, times)


def test_lyndon_array_by_definition():
    rng = np.random.default_rng(5)
    for _ in range(200):
        word = [*rng.integers(0, 3, int(rng.integers(1, 40))).tolist(), -1]
        smaller, shared = periodic.next_smaller(word)
        for i in range(len(word) - 1):
            want = next(j for j in range(i + 1, len(word)) if word[j:] < word[i:])
            same = next(k for k in range(len(word)) if word[i + k] != word[want + k])
            assert (smaller[i], shared[i]) == (want, same)


@pytest.mark.parametrize("unit", [[0], [0, 1, 2, 3, 4, 5, 6], [0, 0, 1], list(range(4000)), [0, 1] * 500 + [2]])
def test_comparisons_are_linear(unit):
    class Counted(int):
        n = 0

        def __eq__(self, other):
            Counted.n += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    own = (unit * (12000 // len(unit)))[:12000]
    periodic.next_smaller([Counted(x) for x in [*own, -1]])
    assert Counted.n <= 4 * len(own)


def test_long_text_with_runs_of_many_periods():
    rng = np.random.default_rng(9)
    words = [b"x%d" % i for i in rng.integers(0, 50, 400)] + [b"a"] * 90 + [b"b", b"c", b"d"] * 40 + [b"u%d" % i for i in range(700)] * 4
    assert periodic.runs_of_words(words) == brute(words, 24, 3)


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = brute(words, 24, 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = sorted(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))[:1]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (
        doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    )


def texts():
    rng = np.random.default_rng(3)
    for i in range(60):
        yield i, " ".join(f"w{x}" for x in rng.integers(0, 400, int(rng.integers(0, 300))))
    yield 60, "la la  " * 30 + "\tend"
    yield 61, None
    yield 62, ""
    yield 62, ""
    yield 63, " \n\t "
    yield None, "q r s " * 20
    yield 64, "é\u00a0é " * 40 + "x " * 7000 + "un deux trois " * 900


def test_query_by_contract(spark, tmp_path):
    rows = list(texts())
    spark.createDataFrame([(i, t, "en", "extra") for i, t in rows], "doc_id long, text string, lang string, runs string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted((contract(i, t) for i, t in rows), key=key)
    assert any(r[1] for r in want) and sorted((tuple(r) for r in got.collect()), key=key) == want


def test_runs_and_collapsed_texts_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "so  " + "ha ho " * 12 + "no", "x"), (2, None, "y"), (3, "a b\n", "z")], "doc_id long, text string, runs string")
    out = periodic.find(df)
    assert out.columns == ["doc_id", "text", "runs", "runs_"]
    got = {r["doc_id"]: [tuple(x) for x in r["runs_"]] for r in out.collect()}
    assert got == {1: [(1, 24, 2)], 2: [], 3: []}
    texts = {r["doc_id"]: r["text"] for r in periodic.collapse(df).collect()}
    assert texts == {1: "so  ha ho no", 2: None, 3: "a b\n"}
    empty = df.filter(F.lit(False))
    assert periodic.find(empty).count() == periodic.collapse(empty).count() == 0
