"""Each stage of the pipeline against a brute-force version, on its own input."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import langid, mixture
from tests.llm.test_pairs_and_repeats import brute_components, brute_repeats
from tests.llm.test_text_models import brute_phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in that was his with for they are", "de": "der die und das ist nicht mit ein auf dem sich wird"}


def prose(lang, seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang].split(), n))


def rows():
    out = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        out.append((i, prose(lang, i, 30 + i), lang if i % 7 else None, f"src{i % 5}" if i % 11 else None))
    passage = prose("en", 900, 70)
    out += [
        (100, out[3][1], "de", "src1"), (101, out[3][1] + " nachtrag", "de", "src1"), (102, passage + " start", "en", "src2"),
        (103, prose("en", 901, 20) + "\n" + passage, "en", "src2")
    ]
    out += [
        (104, None, "en", "src1"), (105, "", "en", "src1"), (106, "123 !!", "en", "src1"), (107, passage + " start", "en", "src3"),
        (107, passage + " start", "en", "src3"), (None, prose("de", 902, 40), "de", "src4")
    ]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in out]


def docs_of(spark, data):
    return spark.createDataFrame(data, DOCS)


def taken(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)


def test_language_stage(spark):
    data = rows()
    docs = docs_of(spark, data)
    drawn = langid.sample(docs.filter("doc_id is null or crc32(cast(doc_id as string)) % 5 <> 0"))
    spell = langid.Speller()
    samples = {k: spell(t).decode() for k, t in drawn.items()}
    want = []
    for i, t, _, s, _ in data:
        plain = spell(t or "").decode()
        if plain.strip():
            cost = {k: brute_phrases(x, plain) * math.log2(max(2, len(x.encode()))) for k, x in samples.items()}
            want.append((i, t, min(sorted(cost), key=cost.get), s))
    assert taken(corpus_pipeline.identify_languages(spark, docs, "")) == sorted(want, key=str)


def test_near_copies_stage(spark):
    data = [r for r in rows() if r[0] is not None]
    once = list({r[0]: r for r in data}.values())
    comps = brute_components([(r[0], r[1]) for r in once], 5, 80)
    want = [r[:4] for r in once if comps[r[0]] == r[0]]
    assert len(want) < len(once)
    assert taken(corpus_pipeline.drop_near_copies(spark, docs_of(spark, data), "")) == sorted(want, key=str)


def test_repeats_stage(spark):
    data = [r for r in rows() if r[0] is not None]
    once = list({r[0]: r for r in data}.values())
    left = brute_repeats([(r[0], r[1]) for r in once], 50)
    found = corpus_pipeline.drop_repeats(spark, docs_of(spark, once), "").collect()
    assert {r["doc_id"]: r["text"].split() for r in found} == {i: w for i, w in left.items() if w}
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert any(len(w) < len((t or "").split()) for (_, t, *_), w in zip(once, left.values(), strict=True))


def shares(budget, children):
    """Whole-number shares of a budget for children (name, capacity, weight): who cannot hold a share gets its capacity."""
    left, out = dict((n, (c, w)) for n, c, w in children), {}
    while True:
        weight = sum(w for _, w in left.values())
        full = {n: c for n, (c, w) in left.items() if c * weight <= w * budget}
        if not full:
            return out | {n: budget * w // weight for n, (_, w) in left.items()}
        for n, c in full.items():
            out[n] = c
            budget -= c
            del left[n]
        if not left:
            return out


def brute_mixture(data):
    units, n = [], lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    for i, t, lang, source, _ in data:
        if n(t):
            number = re.search(r"(\d+)$", source or "unknown")
            units.append((f"domain{int(number[1]) % 4 if number else 0}", lang or "unknown", source or "unknown", i, t, n(t)))
    cap = defaultdict(int)
    for *path, _, _, k in units:
        for depth in range(4):
            cap[tuple(path[:depth])] += k * mixture.MAX_EPOCHS
    budget = {(): cap[()] // mixture.MAX_EPOCHS * mixture.SHARE_PERCENT // 100}
    for depth, level in enumerate(mixture.LEVELS):
        for parent in [p for p in budget if len(p) == depth]:
            children = [(p, cap[p], mixture.WEIGHTS[level].get(p[-1], mixture.OTHER)) for p in cap if len(p) == depth + 1 and p[:depth] == parent]
            budget |= shares(budget[parent], children)
    out = []
    for leaf in [p for p in budget if len(p) == 3]:
        own = [u for u in units if u[:3] == leaf]
        whole, rest = divmod(budget[leaf], cap[leaf] // mixture.MAX_EPOCHS)
        out += [u[3:5] for u in own for _ in range(whole)]
        for u in sorted(own, key=lambda u: hashlib.md5(f"{mixture.SEED}:{whole}:{u[3]}".encode()).hexdigest()):
            if rest > 0:
                words = re.findall(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", u[4])
                out.append((u[3], u[4] if rest >= u[5] else "".join(words[:rest])))
                rest -= u[5]
    return sorted(out)


def test_mixture_stage(spark):
    once = list({r[0]: r for r in rows() if r[0] is not None}.values())
    found = corpus_pipeline.mix(spark, docs_of(spark, once), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == brute_mixture(once)
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_encoding_stage(spark):
    docs = docs_of(spark, rows()).withColumns({"piece_ids": F.lit("mine"), "round_trip": F.lit("mine too")})
    made = corpus_pipeline.encode(spark, docs, "")
    assert made.columns == [*docs.columns, "piece_ids_", "piece_score", "round_trip_"]
    found = made.collect()
    assert len(found) == len(rows()) and all(r["round_trip_"] and r["piece_ids"] == "mine" for r in found)
    assert {r["piece_ids_"] is None for r in found if r["text"] is None} == {True}


@pytest.mark.parametrize("case", ["empty", "nulls", "long", "equal"])
def test_edge_tables_through_all_stages(spark, tmp_path, case):
    long = " ".join(prose("en", k, 500) for k in range(200))
    data = {"empty": [], "nulls": [(None,) * 5] * 3, "long": [*rows(), (300, long, "en", "src1", len(long))], "equal": [rows()[1]] * 9}[case]
    extra = ("_a", "_oid", "_n", "_first", "comp", "epoch", "lang_pred", "decoded", "owner", "cloud")
    docs = docs_of(spark, data).withColumns({c: F.lit(f"own {c}") for c in extra})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = corpus_pipeline.run(spark, str(tmp_path))
    assert made.columns == [*docs.columns, "piece_ids", "piece_score", "round_trip"]
    found = made.collect()
    assert all(r["round_trip"] and all(r[c] == f"own {c}" for c in extra) for r in found)
    assert (not found) == (case in ("empty", "nulls"))


def test_stages_chain(spark, tmp_path):
    """run gives what the stages give one after the other, and each decision takes effect."""
    docs = docs_of(spark, rows())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, str(tmp_path))
        sizes.append(want.count())
    assert taken(corpus_pipeline.run(spark, str(tmp_path))) == taken(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "mixture", "sentencepiece"]
    assert len(rows()) > sizes[0] > sizes[1] >= sizes[2]
