import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import langid, pieces, queries

DOCS = "doc_id long, text string, lang string, source string"


def parquet(spark, path, rows):
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


# --- pieces


def brute_viterbi(encoder, model, chunk):
    """The best score over every way to cut a chunk."""
    of = {p: s for p, s in model["usable"].values()}
    best = [0.0] + [-math.inf] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start in range(end):
            piece = chunk[start:end]
            if piece in of:
                best[end] = max(best[end], best[start] + of[piece])
        if chunk[end - 1] not in of:
            best[end] = max(best[end], best[end - 1] + encoder.fallback)
    return best[-1]


def test_viterbi_is_best():
    model = pieces.load()
    encoder = pieces.Encoder(model)
    for chunk in ("▁thanborly", "▁the", "▁Straßenbahn", "▁日本x語", "▁▁▁a", "▁\n\t", "▁café,", "▁🙂🙂", "▁aaaaaaaa"):
        ids, score = encoder.viterbi(chunk)
        assert score == pytest.approx(brute_viterbi(encoder, model, chunk)), chunk


def test_pieces_round_trip(spark):
    model = pieces.load()
    texts = ["", " ", "a", " leading and  double ", "tab\tnew\nline", "a ▁ b▁", "🙂 ßÄ 日本", "x" * 5000, None, "the same", "the same"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode(rows, model)
    found = {r["doc_id"]: r for r in pieces.decode(coded.withColumnRenamed("piece_ids", "ids"), model, ids="ids").collect()}
    assert {i: found[i]["decoded"] for i in found} == dict(enumerate(texts))
    ids = {r["doc_id"]: r["piece_ids"] for r in coded.collect()}
    assert ids[0] == [] and ids[8] is None and ids[9] == ids[10]
    assert pieces.encode(rows.limit(0), model).count() == 0


def test_pieces_of_many_rows(spark):
    """More rows than are decoded at a time, with nulls among them, and columns of the names that the operator gives."""
    model = pieces.load()
    rows = spark.range(2500).selectExpr(
        "id as doc_id", "if(id % 7 = 0, null, concat('row ', id, ' ünd more')) as text", "'mine' as piece_ids", "'too' as decoded", "3 as _ids"
    ).coalesce(1)
    coded = pieces.encode(rows, model)
    made = pieces.decode(coded, model, ids="piece_ids_")
    assert made.columns == ["doc_id", "text", "piece_ids", "decoded", "_ids", "piece_ids_", "piece_score", "decoded_"]
    found = made.collect()
    assert len(found) == 2500 and all(r["decoded_"] == r["text"] and r["piece_ids"] == "mine" for r in found)


def test_pieces_query(spark, tmp_path):
    rows = [
        (1, "some text", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (4, "x" * 30_000, "en", "s"), (4, "x" * 30_000, "en", "s"),
        (None, "some text", "en", "s")
    ]
    found = queries.QUERIES["op7_sentencepiece"](spark, parquet(spark, tmp_path, rows)).collect()
    assert len(found) == 6 and all(r["round_trip"] for r in found)
    by = {r["doc_id"]: r for r in found}
    assert (by[1]["n_chars"], by[2]["n_pieces"], by[3]["n_pieces"], by[4]["n_chars"]) == (9, 0, 0, 30_000)
    assert by[None]["ids_hash"] == by[1]["ids_hash"] and queries.QUERIES["op7_sentencepiece"](spark, parquet(spark, tmp_path / "e", [])).count() == 0


# --- language


def brute_phrases(sample, text):
    """Greedy longest matches, the start of each found by search."""
    n, at = 0, 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample and "?" not in text[at : end + 1]:
            end += 1
        n, at = n + 1, max(end, at + 1)
    return n


def test_phrases_against_search():
    samples = {"a": "the cat sat on the mat and the hat", "b": "der hund und die katze sind im haus"}
    parser = langid.Parser(langid.fit(samples))
    letters = set("".join(samples.values()))
    for text in ("the cat and the dog", "die katze", "xyz the", "qq", "hund cat", "z"):
        got = parser.phrases([np.frombuffer(parser.spell(text), dtype=np.uint8)])[:, 0]
        plain = "".join(c if c in letters else "?" for c in text)
        assert got.tolist() == [brute_phrases(samples[k], plain) for k in ("a", "b")], text


def test_scripts_with_many_letters_are_told_apart(spark):
    """Far more letters than one table column each could hold, letters beyond U+FFFF, and texts without any."""
    han, hangul, gothic = ("".join(chr(a + i * 7 % n) + " " * (i % 3 == 0) for i in range(3000)) for a, n in ((0x4E00, 5000), (0xAC00, 9000), (0x10330, 26)))
    parser = langid.Parser(langid.fit({"zh": han, "ko": hangul, "got": gothic, "en": "the of and to in that was"}))
    texts = [han[100:180], hangul[40:90], gothic[3:60], "and in that", "😀 12", "😀", "日本" * 3]
    assert [x for x, _ in parser.predict(texts)][:6] == ["zh", "ko", "got", "en", "und", "und"]


def test_language_edge_cases(spark):
    rows = [
        (None, "der hund und die katze", "de"), (None, "der hund und die katze", "de"), (1, "the cat and the dog", "en"),
        (1, "the cat and the dog", "en"), (2, "the cat", "en"), (3, None, None)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("mine"), "_text": F.lit("also")})
    drawn = langid.sample(docs)
    assert drawn == {"de": "der hund und die katze", "en": drawn["en"]} and sorted(len(x) for x in drawn["en"].split(" ")) == [3, 3, 3, 3, 3, 3, 3]
    found = langid.identify(docs, langid.fit(drawn)).collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "_text", "lang_pred_", "lang_score"}
    assert [r["lang_pred_"] for r in found] == ["de", "de", "en", "en", "en", "und"] and {r["lang_pred"] for r in found} == {"mine"}
    tie = langid.Parser(langid.fit({"b": "same words", "a": "same words"}))
    assert tie.predict(["same", "x1"]) == [("a", 0.0), ("a", 0.0)]
    none = langid.identify(docs, langid.fit(langid.sample(docs.filter("false")))).collect()
    assert {(r["lang_pred_"], r["lang_score"]) for r in none} == {("und", 0.0)}


def test_a_language_with_one_long_text_fills_its_share(spark):
    long = " ".join(f"wort{i}" for i in range(4000))
    rows = [(1, long, "de"), *((k, "the cat and the dog " * 9, "en") for k in range(2, 30))]
    drawn = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=40_000)
    assert drawn["de"] == long[:20_000]


def test_more_languages_than_the_bound_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 150)
    rows = [(k, f"text of language {k}", f"l{k:03}") for k in range(150)]
    schema = "doc_id long, text string, lang string"
    assert len(langid.sample(spark.createDataFrame(rows, schema))) == 150
    with pytest.raises(ValueError, match="150"):
        langid.sample(spark.createDataFrame([*rows, (999, "one more", "zz")], schema))


def test_language_query(spark, tmp_path):
    words = {"en": "the of and to in that was his with for", "de": "der die und das ist nicht mit ein auf dem"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[k].split(), 60)), k, "s") for i, k in zip(range(80), itertools.cycle(words), strict=False)]
    rows += [(900, None, "en", "s"), (901, "123 !!", "en", "s"), (902, "", None, None), (903, "der und die " * 3000, None, "s")]
    found = {r["doc_id"]: r for r in queries.QUERIES["op9_language_id"](spark, parquet(spark, tmp_path, rows)).collect()}
    assert all(found[i]["lang_pred"] == lang for i, t, lang, _ in rows[:80])
    assert [found[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    empty = queries.QUERIES["op9_language_id"](spark, parquet(spark, tmp_path / "e", [])).collect()
    assert empty == []


# --- context mixing


def test_scores(spark, tmp_path):
    rng = np.random.default_rng(3)
    stems = ["than", "ble", "er", "ing", "ou", "sh"]
    rows = [(i, " ".join("".join(rng.choice(stems, 2)) for _ in range(40)), "en" if i % 3 else "de", "s") for i in range(120)]
    rows += [
        (500, None, None, None), (501, "", "en", "s"), (502, "Than-THAN zzqy", "en", "s"), (502, "Than-THAN zzqy", "en", "s"),
        (503, "ing " * 4000, "en", "s")
    ]
    found = queries.QUERIES["op2_context_mixing"](spark, parquet(spark, tmp_path, rows)).collect()
    assert len(found) == len(rows)
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b""]
    counts = Counter(w for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    text = {i: t for i, t, *_ in rows}
    for r in found:
        own = split(text[r["doc_id"]])
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert len({r["score"] for r in found if r["doc_id"] == 502}) == 1
