import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from skerry.llm import minhash as M
from skerry.llm import queries

SCHEMA = "doc_id long, text string"
MASK = (1 << 64) - 1


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def chain(*parts):
    """Spark's xxhash64 of several values."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p & MASK).to_bytes(8, "little"), h)
    return h


def brute(text):
    words = re.findall(rf"[^\x20\x09-\x0D]{{1,{M.PIECE}}}", text)
    unit = max((len(words) - 1).bit_length() - M.BITS, 0) if words else 0
    seen, elements = {}, []
    for i in range(len(words)):
        h = signed(chain(*words[i : i + M.K])) >> M.BITS
        n = seen.get(h, 0)
        seen[h] = n + 1
        g = xxhash.xxh64_intdigest((n & 0xFFFFFFFF).to_bytes(4, "little"), xxhash.xxh64_intdigest((h & MASK).to_bytes(8, "little"), 42))
        elements.append((g & (MASK << M.BITS) & MASK, i >> unit))
    out = []
    for b in range(M.BUCKETS):
        own = sorted((signed(g), i) for g, i in elements if g >> (64 - 5) == b)[: M.TUPLE]
        if not own:
            out.append("--------")
            continue
        h = 42
        for g, _ in sorted(own, key=lambda x: (x[1], x[0] & MASK)):  # within a unit by hash
            value = ((g & MASK) >> (M.BITS + 1)) & ((1 << (63 - M.BITS)) - 1)
            h = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), h)
        out.append(f"{h & 0xFFFFFFFF:08x}")
    return "".join(out)


def edited(rows):
    """doc_id to edited text, for distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        out[i] = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = M.compare(docs)
    return {r["oid"]: r for r in found.select(
        "oid", "text", "edited", M.written("own").alias("own"), M.written("edited_own").alias("edited_own"), M.written("next_own").alias("next_own"),
        M.likeness("own", "edited_own").alias("near")
    ).collect()}


@pytest.mark.parametrize("bits", [4, 6])
def test_positions_in_units(spark, monkeypatch, bits):
    """With fewer bits than a text has pieces positions are counted in units: order is kept across units, to the end of the text."""
    monkeypatch.setattr(M, "BITS", bits)
    rows = [(i, " ".join(f"w{(i * 11 + j * 17 + j * j) % 1009}" for j in range(n))) for i, n in enumerate((3, 15, 16, 17, 64, 65, 300, 1000))]
    found = run(spark, rows)
    assert {i: r["own"] for i, r in found.items()} == {i: brute(t) for i, t in rows}
    words = rows[-1][1].split()
    turned = " ".join(words[500:] + words[:500])
    own = spark.createDataFrame([(1, rows[-1][1]), (2, turned)], SCHEMA)
    a, b = (r["f"] for r in M.fingerprint(own, "text", "f").orderBy("doc_id").collect())
    assert a != b  # moved halves show, though nearly all k-mers lie beyond 2^bits


def test_against_brute_force(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(5 + 40 * (i % 4)))) for i in range(12)]
    rows += [(20, "a b a b a b a b a b a b a b"), (21, "x" * 500), (22, ""), (23, "one"), (24, "é ü ñ " * 9)]
    found = run(spark, rows)
    want = edited(rows)
    assert len(found) == len(rows)
    for i, t in rows:
        assert found[i]["edited"] == want[i]
        assert found[i]["own"] == brute(t), i
        assert found[i]["edited_own"] == brute(want[i]), i


def test_repeats_nulls_and_copies(spark):
    rows = [(1, "same text here"), (1, "same text here"), (2, None), (3, "same text here"), (None, "no id")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = M.compare(docs).select("oid", M.written("own").alias("own"), "edited").collect()
    assert len(found) == 5
    assert len({r["own"] for r in found if r["oid"] in (1, 3)}) == 1
    assert M.compare(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = M.compare(spark.createDataFrame([(5, "abcdef")], SCHEMA)).collect()[0]
    assert alone["edited"] == "abcd" + "ab"


def test_order_matters(spark):
    a = " ".join(f"w{i}" for i in range(300))
    moved = " ".join([*(f"w{i}" for i in range(150, 300)), *(f"w{i}" for i in range(150))])
    found = run(spark, [(1, a), (2, moved)])
    same = sum(x == y for x, y in zip(*(re.findall("........", found[i]["own"]) for i in (1, 2)), strict=True))
    assert same < M.BUCKETS * 0.8
    assert hashlib.sha256(a.encode()).hexdigest() != hashlib.sha256(moved.encode()).hexdigest()


@pytest.mark.parametrize("n", [3000])
def test_long_runs(spark, n):
    """A text of one repeated word: occurrence numbers keep its k-mers apart."""
    found = run(spark, [(1, "w " * n), (2, "w " * (n // 2))])
    assert found[1]["own"] == brute("w " * n)


def alike(a, b):
    """Buckets that agree, of those that either text fills."""
    pairs = list(zip(*(re.findall("........", x) for x in (a, b)), strict=True))
    filled = [p for p in pairs if p != ("--------",) * 2]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_op8_contract(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i % 5 * 7 + j) % 61}" for j in range(9 + 30 * (i % 3)))) for i in range(9)] + [(40, ""), (41, None), (42, "one")]
    clash = {c: F.lit(7) for c in ("oid", "th", "own", "edited", "tail", "part", "n", "m", "next_own", "_own_w")}
    spark.createDataFrame(rows, SCHEMA).withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_order_minhash"](spark, str(tmp_path)).collect()}
    plain = [(i, t or "") for i, t in rows]
    want, order = edited(plain), sorted((i for i, _ in plain), reverse=True)
    text = dict(plain)
    for k, i in enumerate(order):
        following = text[order[(k + 1) % len(order)]]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text[i]), hashlib.sha256(want[i].encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (brute(text[i]), brute(want[i]))
        assert r["near_edited"] == pytest.approx(alike(brute(text[i]), brute(want[i]))) and r["near_next"] == pytest.approx(
            alike(brute(text[i]), brute(following))
        )
    assert len({found[i]["fingerprint"] for i in (40, 41)}) == 1
