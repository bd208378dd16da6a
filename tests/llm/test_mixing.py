import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skerry.llm import common, mixing

DOCS = "doc_id long, text string"
STEMS = ["than", "ble", "er", "ing", "ou", "sh", "é"]


def split(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), b""]


def corpus(n=70):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(STEMS, 2)) for _ in range(int(rng.integers(1, 150))))) for i in range(n)]
    return [*rows, (500, None), (501, ""), (502, "Than-THAN zzqy once"), (503, "ing " * 300), (504, "z" * 300 + " er " + "z" * 300), (505, rows[1][1])]


def is_training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 != 0


class Brute:
    """The model by plain loops over texts, tokens and bits. Hashes of contexts are taken from the module, counts are not."""

    def __init__(self, rows, model):
        self.rows, self.model = rows, model
        self.count = Counter(w for i, t in rows if is_training(i) for w in split(t))
        self.n, self.v = sum(self.count.values()), len(self.count)
        order = sorted(self.count, key=lambda w: (-self.count[w], w))
        self.symbol = {w: k for k, w in enumerate(order[: mixing.CODED])}
        tail = [self.count[w] for w in order[mixing.CODED :]]
        self.rest = sum(tail)
        self.discount = tail.count(1) / (tail.count(1) + 2 * tail.count(2)) if 1 in tail else 0.5
        self.left = self.discount * len(tail) / self.rest
        self.codes = mixing.Codes([*(self.count[w] for w in order[: mixing.CODED]), max(self.rest, 1)])
        _, _, tables, self.weights, _, _ = model.shared
        self.bits = len(tables[0]).bit_length() - 1
        self.slots = [defaultdict(lambda: [0, 0]) for _ in range(mixing.ORDERS)]
        for i, t in rows:
            if is_training(i):
                for _, _, bit, slots, _ in self.walk(t):
                    for own, slot in zip(self.slots, slots, strict=True):
                        own[slot][bit] += 1
        self.letters = [defaultdict(lambda: [0, 0]) for _ in range(mixing.SPELL_ORDERS)]
        for w in self.count:
            if len(w) <= 256:
                for _, bit, slots in self.spelled_bits(w):
                    for own, slot in zip(self.letters, slots, strict=True):
                        own[slot][bit] += 1

    def walk(self, text):
        """Every bit of a text: its token's place, node, bit, slots by order, depth."""
        hashes, sizes = mixing.streams([(text or "").encode()])
        symbols = np.array([self.symbol.get(w, len(self.symbol)) for w in split(text)])
        bits = mixing.Bits(self.codes, symbols, mixing.contexts(hashes, sizes), self.bits)
        yield from zip(
            bits.token.tolist(), bits.node.tolist(), bits.bit.tolist(), zip(*(s.tolist() for s in bits.slots), strict=True), bits.depth.tolist(),
            strict=True
        )

    def spelled_bits(self, word):
        letters = mixing.Letters([word])
        for place in range(len(word) + 1):
            for turn in range(8):
                yield turn, int(letters.bit[turn, place]), [int(s[turn, place]) for s in letters.slots]

    def spelling(self, word):
        """Natural logarithm of a word's spelling."""
        if len(word) > 256:
            return -(len(word) + 1) * math.log(256)
        total = 0.0
        for turn, bit, slots in self.spelled_bits(word):
            counts = [own[s] for own, s in zip(self.letters, slots, strict=True)]
            gate = turn * (mixing.SPELL_ORDERS + 1) + sum(sum(c) > 0 for c in counts)
            weights = self.model.letters[1][gate]
            z = sum(w * math.log((c[1] + mixing.PRIOR) / (c[0] + mixing.PRIOR)) for w, c in zip(weights.tolist(), counts, strict=True))
            p = 1 / (1 + math.exp(-z))
            total += math.log(min(max(p if bit else 1 - p, mixing.FLOOR), 1 - mixing.FLOOR))
        return total

    def score(self, text, learned):
        weights = self.weights.astype(float).tolist()
        grid = [-mixing.REACH + 2 * mixing.REACH * k / (mixing.BUCKETS - 1) for k in range(mixing.BUCKETS)]
        refined = [1 / (1 + math.exp(-z)) for z in grid]
        total, held, step = 0.0, [], 0
        for token, node, bit, slots, depth in [*self.walk(text), (10**9, 0, 0, (), 0)]:
            if token // mixing.STEP != step:  # renew the weights and the map
                sums = defaultdict(lambda: [0.0] * mixing.INPUTS)
                cells = defaultdict(list)
                for x, gate, error, cell, b in held:
                    for k in range(mixing.INPUTS):
                        sums[gate][k] += error * x[k]
                    cells[cell].append(b - refined[cell])
                for gate, g in sums.items():
                    weights[gate] = [w + mixing.RATE * d for w, d in zip(weights[gate], g, strict=True)]
                for cell, errors in cells.items():
                    refined[cell] += mixing.MAP_RATE * sum(errors) / max(len(errors), 8)
                held, step = [], token // mixing.STEP
            if token == 10**9:
                break
            x, gate = [0.3, float(self.codes.odds[node])], depth
            for k, slot in enumerate(slots):
                zeros, ones = self.slots[k].get(slot, (0, 0))
                if learned:
                    zeros, ones = max(zeros - (bit == 0), 0), max(ones - (bit == 1), 0)
                x.append(math.log((ones + mixing.PRIOR) / (zeros + mixing.PRIOR)))
                gate += ((zeros + ones > 0) + (zeros + ones > 3)) * 4 * 3**k
            z = sum(w * v for w, v in zip(weights[gate], x, strict=True))
            p = 1 / (1 + math.exp(-z))
            cell = round((min(max(z, -mixing.REACH), mixing.REACH) + mixing.REACH) * (mixing.BUCKETS - 1) / (2 * mixing.REACH))
            q = min(max((p + refined[cell]) / 2, mixing.FLOOR), 1 - mixing.FLOOR)
            total += math.log10(q if bit else 1 - q)
            held.append((x, gate, bit - p, cell, bit))
        for w, n in Counter(w for w in split(text) if w not in self.symbol).items():
            c = self.count[w] - (n if learned else 0)
            total += n * math.log10(max(c - self.discount, 0) / self.rest + 10 ** max(
                math.log10(self.left) + self.spelling(w) / math.log(10), -300
            )) if c > self.discount else n * (math.log10(self.left) + self.spelling(w) / math.log(10))
        return total


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(mixing, "CODED", 12)
    monkeypatch.setattr(mixing, "HEAD", 25)
    monkeypatch.setattr(mixing, "SAMPLE_DOCS", 10)


def test_scores_against_brute_force(spark, small):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["oid"]: r for r in mixing.score(docs).collect()}
    brute = Brute(rows, mixing.Model(*mixing.gather(docs)))
    assert len(found) == len(rows) and 0 < len(brute.symbol) < brute.v
    for i, t in rows:
        own = split(t)
        base = sum(math.log10((brute.count[w] + 0.1) / (brute.n + 0.1 * (brute.v + 1))) for w in own)
        assert found[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (found[i]["n_tokens"], found[i]["n_known"]) == (len(own), sum(brute.count[w] > 0 for w in own))
        assert found[i]["score"] == pytest.approx(brute.score(t, is_training(i)), rel=2e-4), i


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = spark.createDataFrame(corpus(), DOCS)
    scores = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            scores.append({r["oid"]: r["score"] for r in mixing.score(docs.repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)


def test_lanes_and_groups_change_nothing_else(small, monkeypatch):
    """A text that is cut to lanes is scored as its lanes with the contexts of the whole; the company it is in does not matter."""
    codes = mixing.Codes([9, 5, 3, 2, 1])
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 9, (1 << 12, 2)) for _ in range(mixing.ORDERS)]
    mixer = mixing.Mixer(codes, tables)
    hashes, symbols, sizes = rng.integers(1, 2**60, 700, dtype=np.uint64), rng.integers(0, 5, 700), np.array([100, 350, 1, 249])
    whole = mixer.score(hashes, sizes, symbols, np.array([True, False, True, False]))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for k, learned in enumerate((True, False, True, False)):
        cut = slice(edges[k], edges[k + 1])
        assert mixer.score(hashes[cut], sizes[k : k + 1], symbols[cut], np.array([learned]))[0] == pytest.approx(whole[k], rel=1e-12)
    monkeypatch.setattr(mixing, "LANE", 64)
    monkeypatch.setattr(mixing, "BATCH_TOKENS", 100)
    cut = mixer.score(hashes, sizes, symbols, np.array([True, False, True, False]))
    assert cut[0] != whole[0] and cut[2] == pytest.approx(whole[2], rel=1e-12) and np.isfinite(cut).all()


def test_codes_are_a_full_prefix_code():
    for counts in ([1, 1], [5, 3, 2, 1, 1, 0, 7], list(range(1, 300))):
        codes = mixing.Codes(counts)
        sizes = np.diff(codes.starts)
        assert sum(2.0**-n for n in sizes.tolist()) == pytest.approx(1.0) and len(codes.odds) == len(counts) - 1
    assert mixing.Codes([4]).starts.tolist() == [0, 0]


def test_spellings_share_no_more_than_one():
    words = [b"than", b"thin", b"thanks", b"sing", b""]
    letters = mixing.Letters(words)
    tables = [np.bincount((s * 2 + letters.bit).ravel(), minlength=2 << mixing.SPELL_BITS).reshape(-1, 2) for s in letters.slots]
    speller = mixing.Speller(tables)
    total = sum(math.exp(x) for x in speller.spell([b"", *(bytes([c]) for c in range(256) if c != 32)]))
    assert 0 < total <= 1 + 1e-6
    likely = speller.spell([b"than", b"qxzw"])
    assert likely[0] > likely[1]


def test_odds_are_those_of_the_real_counts():
    table = np.array([[70_000, 5_000_000], [1, 0], [0, 0], [3, 9]])
    odds, known = mixing.odds_of(table, False)
    assert odds[0] == pytest.approx(math.log(5_000_000 / 70_000), abs=1e-3) and known.tolist() == [2, 1, 0, 2]
    odds, known = mixing.odds_of(table, True)
    assert known.tolist() == [2, 2, 0, 1, 0, 0, 2, 2] and odds[7] == pytest.approx(math.log(8.4 / 3.4), abs=1e-5)


def test_a_word_of_50_mb(spark, small):
    long = "x" * 50_000_000
    rows = [(1, "er ing " * 20), (2, long), (3, long), (4, "er " + long[:1000])]
    found = {
        r["oid"]: r for r in mixing.score(spark.createDataFrame(rows[:1], DOCS).union(spark.range(2, 4).selectExpr("id", "repeat('x', 50000000)"))).collect()
    }
    assert [found[i]["n_tokens"] for i in (1, 2, 3)] == [41, 2, 2] and all(math.isfinite(r["score"]) for r in found.values())
    assert found[2]["n_bytes"] == len(long) and found[2]["score"] < 0


def test_copies_are_foretold_and_own_text_is_not(spark):
    """A training text is no likelier for being learned, but a copy of it is."""
    rng = np.random.default_rng(9)
    text = lambda k: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(80))
    rows = [(i, text(i)) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    found = {r["oid"]: -r["score"] / r["n_bytes"] for r in mixing.score(spark.createDataFrame(rows, DOCS)).collect()}
    both = [i for i in range(20) if is_training(i) and is_training(1000 + i)]
    alone = [i for i in range(20, 200)]
    assert max(found[i] for i in both) < min(found[i] for i in alone)
    held, trained = ([found[i] for i in alone if is_training(i) == k] for k in (False, True))
    assert np.mean(trained) == pytest.approx(np.mean(held), rel=0.05)


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.score(docs).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], DOCS).selectExpr("*", "1 as oid", "2 as th", "3 as held_out", "'x' as token", "4 as h")
    found = mixing.score(rows).collect()
    assert sorted(r["n_tokens"] for r in found) == [1, 3, 3] and len({r["score"] for r in found if r["n_tokens"] == 3}) == 1


def test_index_finds_what_is_there():
    keys = np.unique(np.random.default_rng(2).integers(1, 2**63, 5000, dtype=np.uint64))
    index = mixing.Index(keys[::2])
    assert index(keys).tolist() == [k // 2 if k % 2 == 0 else -1 for k in range(len(keys))]
    assert mixing.Index(keys[:0])(keys).max() == -1 and len(common.word_hashes(b"")) == 0


def test_start_weights_rest_on_all_training_bits(spark, small):
    """At the weights that texts and spellings start with, the slope over every bit of every training text and word is none."""
    rows = [*corpus(), (600, "ing sher er than ble " * 1200)]
    assert is_training(600) and len(rows[-1][1]) > 20_000
    model = mixing.Model(*mixing.gather(spark.createDataFrame(rows, DOCS)))
    brute = Brute(rows, model)
    near = lambda z, per, low, high: min(max(int(np.rint(np.float32(z) * per)), low), high) / per
    odds = lambda c: math.log((c[1] + mixing.PRIOR) / (c[0] + mixing.PRIOR))

    def check(found, start, bits):
        found, n = found.astype(float), 0
        slope = mixing.PULL * (found - start)
        for gate, x, bit in bits:
            p = 1 / (1 + math.exp(-float(found[gate] @ x)))
            slope[gate] += (p - bit) * np.array(x)
            n += 1
        assert n > 1000 and np.abs(found - start).max() > 0.05 and np.abs(slope).max() < 1e-3 + 1e-6 * n

    def less(own, slot, bit):
        c = own[slot]
        return max(c[0] - (bit == 0), 0), max(c[1] - (bit == 1), 0)

    def of_texts():
        for i, text in rows:
            for _, node, bit, slots, depth in brute.walk(text) if is_training(i) else ():
                counts = [less(own, s, bit) for own, s in zip(brute.slots, slots, strict=True)]
                gate = depth + sum(((sum(c) > 0) + (sum(c) > 3)) * 4 * 3**k for k, c in enumerate(counts))
                yield gate, [0.3, near(brute.codes.odds[node], 4, 0, 7), *(near(odds(c), 2, -16, 15) for c in counts)], bit

    def of_words():
        for w in brute.count:
            for turn, bit, slots in brute.spelled_bits(w) if len(w) <= 256 else ():
                counts = [less(own, s, bit) for own, s in zip(brute.letters, slots, strict=True)]
                yield turn * (mixing.SPELL_ORDERS + 1) + sum(sum(c) > 0 for c in counts), [near(odds(c), 2, -16, 15) for c in counts], bit

    check(model.shared[3], mixing.Mixer(brute.codes, model.shared[2]).weights, of_texts())
    check(model.letters[1], mixing.Speller(model.letters[0]).weights, of_words())


def test_three_levels_of_a_context_lie_side_by_side():
    """So a token looks into a third as many places; within them each node has a slot of its own."""
    codes = mixing.Codes(np.random.default_rng(4).integers(1, 500, 300).tolist())
    symbols = np.arange(300)
    bits = mixing.Bits(codes, symbols, [np.full(300, 0x1234 << 16, dtype=np.uint32)], 20)
    turn = np.arange(len(bits.token)) - np.repeat(bits.ends - bits.sizes, bits.sizes)
    place, slots = bits.token * 64 + turn // 3, bits.slots[0].astype(np.int64)
    assert all(len(set((slots[place == k] >> 3).tolist())) == 1 for k in set(place.tolist()))
    for k in set((slots >> 3).tolist()):
        nodes, own = bits.node[slots >> 3 == k], slots[slots >> 3 == k]
        roots = {bits.node[i] for i in np.flatnonzero((slots >> 3 == k) & (turn % 3 == 0))}
        if len(roots) == 1:
            assert len(set(nodes.tolist())) == len(set(own.tolist()))


def test_texts_that_hold_the_mark_are_hashed_by_themselves():
    texts = [b"A b", b"", b"c \0 d", b"b\0 ", b" x" * 40_000]
    for some in (texts, texts[:2] + texts[3:]):
        hashes, sizes = mixing.streams(some)
        alone = [np.append(common.word_hashes(t.lower()), mixing.END) for t in some]
        assert hashes.tolist() == np.concatenate(alone).tolist() and sizes.tolist() == [len(x) for x in alone]


def test_counts_by_task_are_whole():
    numbers = np.random.default_rng(5).integers(0, 1 << 15, (7, 1000))
    parts = list(mixing._counts(([x] for x in numbers), [1 << 15]))
    total = sum(np.frombuffer(c.as_buffer(), dtype="<i4") for b in parts for c in [b.column(1)[0]])
    assert total[: mixing.CHUNK * 2].tolist() == np.bincount(numbers.ravel(), minlength=1 << 15)[: len(total)].tolist()
    assert list(mixing._counts(iter([]), [16])) == []
