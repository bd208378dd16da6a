"""Language-model scoring by online logistic context mixing.

Tokens are coded bit by bit. The CODED most frequent training tokens, of those that occur CODED_LEAST times or more, have
Huffman codes of their own, all others share one code, the escape: a word must not have one because its own text was learned. For every bit hashed contexts give a prediction: none (the node of the code tree), the token before, the
two tokens before, each with the node; contexts reach across words. Counts of zeros and ones by hashed slot are gathered
over all training texts. Their log odds are mixed in the logistic domain by weights that a gate chooses: how often the two
contexts were seen, and the depth in the code. The weights are learned online: after each STEP tokens of a text from its
errors; a text starts with weights that a logistic regression on all bits of all training texts gives, which are counted by
gate and rounded inputs for it, so their number and size do not matter. An adaptive map from the mixed odds to what
the text's bits came out as refines the result, and is also renewed after each step.

After an escape a token costs what a discounted unigram model over all escaped training tokens says, max(c - D, 0) / N,
plus the mass that discounting leaves times the token's spelling: its bytes and a closing space, bit by bit, from hashed
contexts of 1 to 3 bytes, mixed by gated weights too, found the same way from all training words. These counts are of
all words and are joined by hash, so what is gathered grows with the corpus; the list of the HEAD most frequent words is
sent to every task.

A training text is scored by what the other texts teach: a bit's own count is taken off its slot, a text's own counts off
those of its escaped tokens, so that a text does not look likely because it was learned itself, but does if copies of it
were, as far as the tables have room. Every text has a score by itself: results do not depend on the order of rows or the number of partitions. A text of
more than LANE tokens starts a new set of weights each LANE tokens; its contexts go on.

Bounds (parameters): CODED, CODED_LEAST, HEAD; 2^TABLE_BITS slots a context, 2^SPELL_BITS for spellings (the more tokens, the more
share a slot; those of three levels of the code tree under one node lie side by side). Words of more than LONG bytes are counted by digest and spelled flat, 8 bits a byte. Null texts are empty (one token, the end), null ids
count as the empty text for the fold. Rows equal in id and text get equal scores. Without training texts all counts are 0.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CODED, CODED_LEAST, HEAD = 32_768, 3, 100_000
TABLE_BITS, SPELL_BITS = 20, 18
STEP, LANE, BATCH_TOKENS, COUNT_TOKENS = 64, 1 << 12, 8192, 8192
GROUP_BYTES = 1 << 21
SAMPLE_DOCS = None  # no sample is taken; a fixture of the tests still sets it
LONG, SPELL_BYTES, FLUSH = common.LONG_WORD, 1 << 13, 1_000_000
ORDERS, SPELL_ORDERS = 2, 3
INPUTS, GATES = ORDERS + 2, 9 * 4
BUCKETS, REACH = 33, 8.0
CELL_BITS, SPELL_CELL_BITS, PULL = 19, 20, 32.0
RATE, MAP_RATE, PRIOR, FLOOR = 0.02, 0.2, 0.4, 1.0 / 4096
END = np.uint64(0x5BD1E995C0FFEE11)
"""The hash of the token that ends a text, and of what stands before its first."""
MARK = b"\0"
"""The word that stands between texts while they are hashed together."""
LOW = np.uint32(511)
"""The bits of a context's hash that are left to flags, so a table has 2^23 slots at most."""
_NODE, _SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- words of the corpus


def key_of(word: bytes) -> bytes:
    """What a word is counted by: itself, or for a long one a space (no word has one), its length, a digest and its hash."""
    if len(word) <= LONG:
        return word
    digest = hashlib.blake2b(word, digest_size=16).digest()
    return b" " + len(word).to_bytes(8, "big") + digest + xxhash.xxh64_intdigest(word).to_bytes(8, "little")


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """The hashes of words by their keys, as `streams` finds them in texts."""
    out = np.full(len(keys), END, dtype=np.uint64)
    plain = [i for i, k in enumerate(keys) if k and k[0] != 32]
    out[plain] = common.word_hashes(b" ".join([keys[i] for i in plain]))
    for i, k in enumerate(keys):
        if k[:1] == b" ":
            out[i] = int.from_bytes(k[-8:], "little")
    return out


def streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' tokens, one text after the other, and the number of tokens of each."""
    hashes = common.word_hashes(b"".join([t.lower() + b" " + MARK + b" " for t in texts]))
    ends = np.flatnonzero(hashes == common.word_hashes(MARK))
    if len(ends) == len(texts):
        hashes[ends] = END
        return hashes, np.diff(ends, prepend=-1)
    # A text has the mark as a word of its own.
    parts = [np.append(common.word_hashes(t.lower()), END) for t in texts]
    return np.concatenate(parts), np.array([len(x) for x in parts])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by key with their counts, in training texts and in all; batches of (held_out, text)."""
    counts: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})

    def flush() -> pa.RecordBatch:
        words = list(counts[0] | counts[1])
        train, held = (np.fromiter((d.get(w, 0) for w in words), dtype=np.int64, count=len(words)) for d in counts)
        for d in counts:
            d.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(train), pa.array(train + held)], names=["token", "c", "c_all"])

    for batch in batches:
        held_out, at = batch.column(0).to_pylist(), 0
        for group in common.text_groups(batch.column(1), GROUP_BYTES):
            own: tuple[list, list] = ([], [])
            for k, text in enumerate(group):
                words = own[held_out[at + k]]
                words += text.lower().split()
                words.append(b"")
            at += len(group)
            for total, words in zip(counts, own, strict=True):
                for w, n in Counter(words).items():
                    if len(w) > LONG:
                        w = key_of(w)
                    total[w] = total.get(w, 0) + n
            if len(counts[0]) > FLUSH or len(counts[1]) > FLUSH:
                yield flush()
    yield flush()


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their hash; batches of (token, c, c_all)."""
    for batch in batches:
        hashes = pa.array(common.signed(hashes_of(batch.column(0).to_pylist())))
        yield pa.RecordBatch.from_arrays([batch.column(0), hashes, *batch.columns[1:]], names=["token", "h", "c", "c_all"])


def least_count(words: DataFrame, most: int) -> float:
    """A count that at most so many words reach, from a histogram by logarithm (some hundred rows), so nothing is sorted."""
    level = F.floor(F.log("c_all") * 16).cast("int")
    levels = {r["level"]: r["count"] for r in words.groupBy(level.alias("level")).count().collect()}
    total, least = 0, max(levels, default=0) + 1
    for k in sorted(levels, reverse=True):
        total += levels[k]
        if total > most:
            break
        least = k
    return float(np.exp(least / 16))


class Index:
    """Places of 64-bit keys, by hashing into a table that is at most half full; each round of a look-up has its own hash."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.places = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)
        left, self.rounds = np.arange(len(keys)), 0
        while len(left):
            at = self._at(keys[left], self.rounds)
            free = np.flatnonzero(self.places[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.places[slot] = keys[left[free[first]]], left[free[first]]
            left = np.delete(left, free[first])
            self.rounds += 1

    def _at(self, keys: np.ndarray, turn: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x1234567)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is not there."""
        out = np.full(len(keys), -1, dtype=np.int32)
        todo = None
        for turn in range(self.rounds):
            at = self._at(keys if todo is None else keys[todo], turn)
            place = self.places[at]
            hit = (place >= 0) & (self.keys[at] == (keys if todo is None else keys[todo]))
            missed = (place >= 0) & ~hit
            if todo is None:
                out, todo = np.where(hit, place, -1).astype(np.int32), np.flatnonzero(missed)
            else:
                out[todo[hit]] = place[hit]
                todo = todo[missed]
            if not len(todo):
                break
        return out


# --- codes and contexts of tokens


class Codes:
    """Huffman codes of symbols by their counts: bits and tree nodes of symbol s from starts[s] to starts[s + 1]."""

    def __init__(self, counts: list[int]) -> None:
        heap = [(max(c, 1), i, None) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        inner = 0
        odds = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            odds.append(np.log(b[0] / a[0]))
            heapq.heappush(heap, (a[0] + b[0], len(counts) + inner, (inner, a, b)))
            inner += 1
        self.odds = np.array(odds, dtype=np.float32)
        path: list[list[tuple[int, int]]] = [[] for _ in counts]
        todo = [(heap[0], [])] if heap else []
        while todo:
            (_, symbol, split), own = todo.pop()
            if split is None:
                path[symbol] = own
            else:
                node, a, b = split
                todo += [(a, [*own, (node, 0)]), (b, [*own, (node, 1)])]
        self.sizes = np.array([len(p) for p in path], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.nodes = np.array([n for p in path for n, _ in p], dtype=np.int64)
        bits = np.array([b for p in path for _, b in p], dtype=np.int64)
        place = np.arange(len(bits)) - np.repeat(self.starts[:-1], self.sizes)
        # What a bit's slot adds to its context's, in the upper bits, is that of the node from which its three levels of the
        # tree hang, so their slots lie side by side; which of them it is: 1, 2 + the bit before, 4 + the two before.
        turn, at = place % 3, np.arange(len(bits))
        one, two = bits[np.maximum(at - 1, 0)], bits[np.maximum(at - 2, 0)]
        local = np.where(turn == 0, 1, np.where(turn == 1, 2 + one, 4 + 2 * two + one))
        spread = self.nodes[at - turn].astype(np.uint64) * _NODE * _SLOT >> np.uint64(32)
        flags = np.minimum(place // 3, 3) << 7 | _bins(self.odds[self.nodes], 4, 0, 7) << 4 | bits << 3 | local
        self.packs = spread.astype(np.uint32) & ~LOW | flags.astype(np.uint32)
        self.leans = self.odds[self.nodes]


class Bits:
    """The bits of tokens: the token of each, its slot by order, bit, node and depth; where the bits of each end."""

    def __init__(self, codes: Codes, symbols: np.ndarray, before: list[np.ndarray], table_bits: int) -> None:
        self.codes, self.sizes = codes, codes.sizes[symbols]
        self.ends = np.cumsum(self.sizes)
        self.at = np.repeat(codes.starts[symbols] + self.sizes - self.ends, self.sizes)
        self.at += np.arange(len(self.at))
        self.pack = codes.packs.take(self.at, mode="clip")
        self.bit = (self.pack >> np.uint32(3)) & np.uint32(1)
        local, shift = self.pack & np.uint32(7), np.uint32(32 - table_bits)
        self.slots = [((np.repeat(c, self.sizes) + self.pack) >> shift) ^ local for c in before]

    @property
    def token(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def node(self) -> np.ndarray:
        return self.codes.nodes[self.at]

    @property
    def depth(self) -> np.ndarray:
        return (self.pack >> np.uint32(7)) & np.uint32(3)


def contexts(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Hashed contexts of tokens by order: the token before, the two before; END stands before a text."""
    starts = np.cumsum(sizes) - sizes
    one = np.concatenate([[END], hashes[:-1]]) if len(hashes) else hashes
    one[starts] = END
    two = np.concatenate([[END], one[:-1]]) if len(hashes) else hashes
    two[starts] = END
    both = common.mix64(one), common.mix64(one * np.uint64(3) + common.mix64(two))
    return [(x >> np.uint64(32)).astype(np.uint32) & ~LOW for x in both]


def _training_bits(batches: Iterator[pa.RecordBatch], index: Index, codes: Codes, coded: int, table_bits: int) -> Iterator[Bits]:
    """The bits of texts, COUNT_TOKENS tokens at a time, so what is made of them stays in the caches."""
    for batch in batches:
        for group in common.text_groups(batch.column(0), GROUP_BYTES):
            hashes, sizes = streams(group)
            place = index(hashes)
            symbols = np.where((place >= 0) & (place < coded), place, coded)
            before = contexts(hashes, sizes)
            for a in range(0, len(hashes), COUNT_TOKENS):
                cut = slice(a, a + COUNT_TOKENS)
                yield Bits(codes, symbols[cut], [c[cut] for c in before], table_bits)


def _counts(parts: Iterator[list[np.ndarray]], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """How often each number occurs, by table, as chunks; before a count can leave 32 bits, what there is goes out."""
    tables, seen, some = [np.zeros(n, dtype=np.int32) for n in sizes], 0, False
    for part in parts:
        if seen + part[0].size >= 2**31:
            yield from _chunks(tables)
            seen = 0
            for table in tables:
                table[:] = 0
        for table, numbers in zip(tables, part, strict=True):
            np.add.at(table, numbers, np.int32(1))  # of the same type, or each is converted
        seen, some = seen + part[0].size, True
    if some:
        yield from _chunks(tables)


def _table_batches(shared):
    """Counts of zeros and ones in every slot of every order over the training texts of a task, as chunks of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, codes, coded, table_bits = pickle.loads(shared.value)
        found = ([(s << np.uint32(1) | b.bit).astype(np.int64) for s in b.slots] for b in _training_bits(batches, index, codes, coded, table_bits))
        yield from _counts(found, [2 << table_bits] * ORDERS)

    return run


CHUNK = 8192


def _chunks(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for order, table in enumerate(tables):
        parts = table.astype("<i4").reshape(-1, min(len(table), CHUNK * 2))
        key = pa.array(np.arange(len(parts)) * 8 + order, pa.int64())
        yield pa.RecordBatch.from_arrays([key, pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])


def _add_chunks(chunk: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), dtype="<i4").astype(np.int64) for x in chunk["counts"])
    kind = "<i8" if total.max(initial=0) >= 2**31 else "<i4"
    return pa.table({"chunk": chunk["chunk"][:1], "counts": pa.array([total.astype(kind).tobytes()], pa.binary())})


def add_tables(parts: DataFrame, orders: int, bits: int) -> list[np.ndarray]:
    """The sums of tables that came in chunks, by order an array of pairs; their size is fixed. 32 bits where counts fit."""
    found = parts.groupBy("chunk").applyInArrow(_add_chunks, "chunk long, counts binary").toArrow()
    size = min(2 << bits, CHUNK * 2)
    wide = any(len(c.as_buffer()) > 4 * size for c in found["counts"])
    tables = [np.zeros(2 << bits, dtype=np.int64 if wide else np.int32) for _ in range(orders)]
    for key, counts in zip(found["chunk"].to_pylist(), found["counts"], strict=True):
        own = np.frombuffer(counts.as_buffer(), dtype="<i8" if len(counts.as_buffer()) > 4 * size else "<i4")
        tables[key % 8][key // 8 * size : (key // 8 + 1) * size] = own
    return [t.reshape(-1, 2) for t in tables]


def odds_of(table: np.ndarray, without_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of real counts and how well they are known (0 unseen, 1 once to three times, 2 more), by slot; without_self
    by slot and bit, with one count of that bit taken off."""
    if without_self:
        less = [np.maximum(table - np.array(own, dtype=table.dtype), 0) for own in ((1, 0), (0, 1))]
        table = np.stack(less, axis=1).reshape(-1, 2)
    logs = np.log(table.astype(np.float32) + np.float32(PRIOR))
    seen = table[:, 0] + table[:, 1]
    return logs[:, 1] - logs[:, 0], ((seen > 0).astype(np.int8) + (seen > 3))


def packed(odds: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Odds with how well they are known in their two lowest bits, so both are looked up at once."""
    return (odds.view(np.int32) & ~np.int32(3) | known).view(np.float32)


def _bins(odds: np.ndarray, per: int, low: int, high: int) -> np.ndarray:
    """Numbers, from 0, of the bins of odds, so many to a unit; the outer ones hold all that lies beyond."""
    return (np.clip(np.rint(odds * per), low, high) - low).astype(np.int32)


def _middles(cells: np.ndarray, at: int) -> np.ndarray:
    return ((cells >> at) & 31) / 2 - REACH


def fitted(counts: np.ndarray, x: np.ndarray, gate: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights by gate of a logistic regression on counts of zeros and ones in cells with inputs x; few bits leave them near start."""
    out = start.astype(np.float64)
    for g in np.unique(gate):
        own, n = x[gate == g], counts[gate == g].sum(axis=1)
        ones, w = counts[gate == g][:, 1], out[g].copy()

        def cost(w, own=own, n=n, ones=ones, first=start[g]):
            z = own @ w
            return (n * np.logaddexp(0, z) - ones * z).sum() + PULL / 2 * ((w - first) ** 2).sum()

        for _ in range(30):
            p = 1 / (1 + np.exp(-(own @ w)))
            slope = own.T @ (n * p - ones) + PULL * (w - start[g])
            move = np.linalg.solve((own * (n * p * (1 - p))[:, None]).T @ own + PULL * np.eye(len(w)), slope)
            size = 1.0
            while size > 1e-4 and cost(w - size * move) > cost(w):
                size /= 2
            if size <= 1e-4 or np.abs(move).max() < 1e-9:
                break
            w -= size * move
        out[g] = w
    return out.astype(np.float32)


class Cells:
    """Cells of bits of training texts: gate, the node's odds (3 bits) and the odds by order (5 bits each), without the bit's own count."""

    start = np.tile(np.array([0.0, 0.6, 0.3, 0.3], dtype=np.float32), (GATES, 1))

    def __init__(self, tables: list[np.ndarray]) -> None:
        self.orders = []
        for k, table in enumerate(tables):
            odds, known = odds_of(table, True)
            self.orders.append((known.astype(np.int32) * (4 * 3**k) << 13) + (_bins(odds, 2, -16, 15) << (5 * k)))

    def __call__(self, bits: Bits) -> np.ndarray:
        """A bit's cell is the sum of what its depth, its node and its slots add."""
        cell = ((bits.pack & np.uint32(0x1F0)) << np.uint32(6)).view(np.int32)
        for part, slot in zip(self.orders, bits.slots, strict=True):
            cell += part.take(slot << np.uint32(1) | bits.bit, mode="clip")
        return cell

    @classmethod
    def weights(cls, counts: np.ndarray) -> np.ndarray:
        cells = np.flatnonzero(counts.any(axis=1))
        x = np.stack([np.full(len(cells), 0.3), ((cells >> 10) & 7) / 4, _middles(cells, 0), _middles(cells, 5)], axis=1)
        return fitted(counts[cells], x, cells >> 13, cls.start)


def _cell_batches(shared):
    """Counts of zeros and ones in every cell over the training texts of a task, as chunks of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, codes, coded, table_bits, cells = pickle.loads(shared.value)
        found = ([cells(b).astype(np.int64) << 1 | b.bit] for b in _training_bits(batches, index, codes, coded, table_bits))
        yield from _counts(found, [2 << CELL_BITS])

    return run


class Mixer:
    """Predicts the bits of texts: inputs from the tables, weights and a map for each lane."""

    def __init__(self, codes: Codes, tables: list[np.ndarray], weights: np.ndarray | None = None) -> None:
        self.codes, self.table_bits = codes, len(tables[0]).bit_length() - 1
        # What slots say by order, for a training text (by slot and bit, without its own count) and for others (by slot).
        self.tables = {own: [packed(*odds_of(t, own)) for t in tables] for own in (True, False)}
        self.weights = Cells.start if weights is None else weights

    def inputs(self, bits: Bits, learned: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Inputs beside the constant (the node's odds, those by order) and the gate of every bit."""
        x = [self.codes.leans.take(bits.at, mode="clip")]
        gate = bits.depth.view(np.int32)
        for k, (table, slot) in enumerate(zip(self.tables[learned], bits.slots, strict=True)):
            odds = table.take(slot << np.uint32(1) | bits.bit if learned else slot, mode="clip")
            gate += (odds.view(np.int32) & np.int32(3)) * np.int32(4 * 3**k)
            x.append(odds)
        return x, gate.astype(np.int64)

    def run(self, first: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, before: list[np.ndarray], learned: bool) -> np.ndarray:
        """Natural logarithms of the probabilities of lanes, each so many tokens from its first; the longest lanes come first."""
        lanes = len(sizes)
        weights = [np.tile(self.weights[:, k], lanes) for k in range(INPUTS)]
        centre = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, BUCKETS)))
        refined = np.tile(centre.astype(np.float32), lanes)
        total, scale = np.zeros(lanes), np.float32((BUCKETS - 1) / (2 * REACH))
        if not len(self.codes.packs):
            return total
        for a in range(0, int(sizes[0]), STEP):
            # The lanes that go on, their tokens of this step, and the bits of those: first by lane, then in their order.
            n = int(np.searchsorted(-sizes, -a))
            own = np.minimum(sizes[:n] - a, STEP)
            ends = np.cumsum(own)
            token = np.repeat(first[:n] + a + own - ends, own)
            token += np.arange(len(token))
            bits = Bits(self.codes, symbols[token], [c[token] for c in before], self.table_bits)
            ends = bits.ends[ends - 1]
            starts = np.concatenate([[0], ends[:-1]])
            lane = np.repeat(np.arange(n), ends - starts)
            x, gate = self.inputs(bits, learned)
            gate += lane * GATES
            bit = bits.bit.astype(np.float32)
            mixed = weights[0].take(gate, mode="clip") * np.float32(0.3)
            for k, odds in enumerate(x):
                mixed += weights[k + 1].take(gate, mode="clip") * odds
            p = 1 / (1 + np.exp(-mixed))
            cell = np.rint((np.clip(mixed, -REACH, REACH) + np.float32(REACH)) * scale).astype(np.int64)
            cell += lane * BUCKETS
            said = refined.take(cell, mode="clip")
            q = np.clip((p + said) * np.float32(0.5), FLOOR, 1 - FLOOR)
            total[:n] += np.add.reduceat(np.log(np.abs(1 - bit - q)), starts, dtype=np.float64)
            # Sums are made of 64-bit numbers: bincount converts others at several times the cost.
            error, size = bit - p, n * GATES
            weights[0][:size] += RATE * 0.3 * np.bincount(gate, weights=error.astype(np.float64), minlength=size)
            for k, odds in enumerate(x):
                weights[k + 1][:size] += RATE * np.bincount(gate, weights=(error * odds).astype(np.float64), minlength=size)
            size = n * BUCKETS
            moved = np.bincount(cell, weights=(bit - said).astype(np.float64), minlength=size)
            refined[:size] += MAP_RATE * (moved / np.maximum(np.bincount(cell, minlength=size), 8))
        return total

    def score(self, hashes: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, learned: np.ndarray) -> np.ndarray:
        """log10 probabilities of the symbols of texts. Lanes go together by length, BATCH_TOKENS tokens a step at most."""
        before, out = contexts(hashes, sizes), np.zeros(len(sizes))
        starts = np.cumsum(sizes) - sizes
        parts = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), parts)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * LANE + starts[text]
        size = np.minimum(LANE, starts[text] + sizes[text] - first)
        for kind in (False, True):
            own = np.flatnonzero(learned[text] == kind)
            own = own[np.argsort(-size[own], kind="stable")]
            step = np.minimum(size[own], STEP)
            for some in np.split(own, np.flatnonzero(np.diff(np.cumsum(step) // BATCH_TOKENS)) + 1):
                if len(some):
                    np.add.at(out, text[some], self.run(first[some], size[some], symbols, before, kind))
        return out / np.log(10)


# --- spellings of words


_TURNS = np.arange(8, dtype=np.uint64)[:, None]
_LETTER_NODES = (((1 << _TURNS | np.arange(256, dtype=np.uint64) >> (8 - _TURNS)) * _NODE * _SLOT) >> np.uint64(32)).astype(np.uint32)
"""What the bits of a byte before one, by its place and the byte, add to the hash of a context."""


class Letters:
    """The bits of words' bytes and closing spaces: slots by order and the bit's place."""

    def __init__(self, words: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        sizes = np.array([len(w) + 1 for w in words])
        self.starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(self.starts, sizes)
        node = np.stack([own.take(data, mode="clip") for own in _LETTER_NODES])
        self.bit = np.stack([data >> np.uint8(7 - k) & np.uint8(1) for k in range(8)])
        self.slots, context = [], np.zeros(len(data), dtype=np.uint64)
        for k in range(1, SPELL_ORDERS + 1):
            last = np.zeros(len(data), dtype=np.uint64)
            last[k:] = np.where(place[k:] >= k, data[:-k], 0)
            context = context | last << np.uint64(8 * (k - 1))
            base = (common.mix64(context * np.uint64(8) + np.uint64(k)) >> np.uint64(32)).astype(np.uint32)
            self.slots.append(((base + node) >> np.uint32(32 - SPELL_BITS)).view(np.int32))


class Speller:
    """Log probabilities of words' spellings: odds by order, mixed by weights that the bit's place and the number of known
    contexts choose."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None) -> None:
        self.tables = [packed(*odds_of(t, False)) for t in tables]
        self.weights = LetterCells.start if weights is None else weights

    def mix(self, bits: Letters) -> np.ndarray:
        odds = [own.take(slot, mode="clip") for own, slot in zip(self.tables, bits.slots, strict=True)]
        known = sum((x.view(np.int32) & np.int32(3)) > 0 for x in odds)
        gate = known + np.arange(8)[:, None] * (SPELL_ORDERS + 1)
        return sum(self.weights[:, k].take(gate, mode="clip") * odds[k] for k in range(SPELL_ORDERS))

    def spell(self, keys: list[bytes]) -> np.ndarray:
        """Natural logarithms of the probabilities of words, given by their keys."""
        out = np.empty(len(keys))
        long = [i for i, k in enumerate(keys) if k[:1] == b" "]
        out[long] = [-(int.from_bytes(keys[i][1:9], "big") + 1) * np.log(256) for i in long]
        plain = [i for i, k in enumerate(keys) if k[:1] != b" "]
        at = 0
        for some in spans([keys[i] for i in plain]):
            bits = Letters(some)
            p = 1 / (1 + np.exp(self.mix(bits) * (1 - 2 * bits.bit.astype(np.float32))))
            p = np.clip(p, FLOOR, 1 - FLOOR)
            out[plain[at : at + len(some)]] = np.add.reduceat(np.log(p).sum(axis=0, dtype=np.float64), bits.starts)
            at += len(some)
        return out


def spans(words: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of words of SPELL_BYTES bytes or one word."""
    sizes = np.cumsum([len(w) + 1 for w in words])
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SPELL_BYTES, side="right")))
        yield words[at:end]
        at = end


class LetterCells:
    """Cells of bits of spellings: the bit's place, the number of known contexts and the odds by order (5 bits each), without the
    word's own count."""

    start = np.full((8 * (SPELL_ORDERS + 1), SPELL_ORDERS), 0.4, dtype=np.float32)

    def __init__(self, tables: list[np.ndarray]) -> None:
        self.orders = []
        for k, table in enumerate(tables):
            odds, known = odds_of(table, True)
            self.orders.append(((known > 0).astype(np.int32) << 15) + (_bins(odds, 2, -16, 15) << (5 * k)))

    def __call__(self, bits: Letters) -> np.ndarray:
        own = [part.take(slot << 1 | bits.bit, mode="clip") for part, slot in zip(self.orders, bits.slots, strict=True)]
        return sum(own) + (np.arange(8, dtype=np.int32)[:, None] * (SPELL_ORDERS + 1) << 15)

    @classmethod
    def weights(cls, counts: np.ndarray) -> np.ndarray:
        cells = np.flatnonzero(counts.any(axis=1))
        x = np.stack([_middles(cells, 5 * k) for k in range(SPELL_ORDERS)], axis=1)
        return fitted(counts[cells], x, cells >> 15, cls.start)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[Letters]:
    """The bits of the words of a task, but long ones."""
    for batch in batches:
        for part in spans([w for w in common.raw_bytes(batch.column(0)) if w[:1] != b" "]):
            yield Letters(part)


def _letter_cell_batches(shared):
    """Counts of zeros and ones in every cell over the words of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = LetterCells(pickle.loads(shared.value))
        found = ([(cells(o) << 1 | o.bit).ravel().astype(np.int64)] for o in _spelled(batches))
        yield from _counts(found, [2 << SPELL_CELL_BITS])

    return run


def _letter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ([(slot << 1 | o.bit).ravel().astype(np.int64) for slot in o.slots] for o in _spelled(batches))
    yield from _counts(found, [2 << SPELL_BITS] * SPELL_ORDERS)


# --- the model


class Model:
    """What training found. `shared` is what scoring texts needs, `tail` what the worth of escaped tokens needs."""

    def __init__(self, source: DataFrame, words: DataFrame) -> None:
        session = source.sparkSession.sparkContext
        head = words.filter(F.col("c_all") >= least_count(words, HEAD)).select("token", "h", "c").toArrow()
        tokens, counts = head["token"].to_pylist(), head["c"].to_numpy()
        order = sorted(range(len(tokens)), key=lambda i: (-counts[i], tokens[i]))
        tokens, counts = [tokens[i] for i in order], counts[order]
        self.coded = min(CODED, int((counts >= CODED_LEAST).sum()))
        one = lambda n: F.count(F.when(F.col("c") == n, 1))
        self.n, self.v, n1, n2 = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), one(1), one(2)).first()
        first = counts[: self.coded]
        n1, n2 = n1 - int((first == 1).sum()), n2 - int((first == 2).sum())
        self.rest, rest_v = self.n - int(first.sum()), self.v - self.coded
        self.discount = n1 / (n1 + 2 * n2) if n1 else 0.5
        self.left = self.discount * rest_v / self.rest if self.rest else 1.0
        index, codes = Index(hashes_of(tokens)), Codes([*first.tolist(), max(self.rest, 1)])
        bits = int(np.clip(int(self.n).bit_length() + 1, 12, TABLE_BITS))
        learn = session.broadcast(cloudpickle.dumps((index, codes, self.coded, bits)))
        texts = source.filter("not held_out").select("text")
        tables = add_tables(common.map_batches(texts, _table_batches(learn), "chunk long, counts binary"), ORDERS, bits)
        learn.unpersist()
        cells = session.broadcast(cloudpickle.dumps((index, codes, self.coded, bits, Cells(tables))))
        weights = Cells.weights(add_tables(common.map_batches(texts, _cell_batches(cells), "chunk long, counts binary"), 1, CELL_BITS)[0])
        cells.unpersist()
        spelled = words.filter("c > 0").select("token")
        letters = add_tables(common.map_batches(spelled, _letter_batches, "chunk long, counts binary"), SPELL_ORDERS, SPELL_BITS)
        cells = session.broadcast(cloudpickle.dumps(letters))
        found = add_tables(common.map_batches(spelled, _letter_cell_batches(cells), "chunk long, counts binary"), 1, SPELL_CELL_BITS)[0]
        cells.unpersist()
        speller = Speller(letters, LetterCells.weights(found))
        self.letters = (letters, speller.weights)
        self.shared = (index, codes, tables, weights, counts, speller.spell(tokens))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def worth(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 probabilities of escaped tokens with c counts; spelled is a natural logarithm."""
        seen = np.maximum(c - self.discount, 0) / max(self.rest, 1)
        rare = np.log10(self.left) + spelled / np.log(10)
        return np.where(seen > 0, np.log10(np.where(seen > 0, seen, 1) + 10.0 ** np.maximum(rare, -300)), rare)

    def worth_column(self, c: str, spelled: str) -> F.Column:
        """The same on columns."""
        seen = F.greatest(F.expr(c) - F.lit(float(self.discount)), F.lit(0.0)) / F.lit(float(max(self.rest, 1)))
        rare = F.lit(float(np.log10(self.left))) + F.col(spelled) / F.lit(float(np.log(10)))
        return F.when(seen > 0, F.log10(seen + F.pow(F.lit(10.0), F.greatest(rare, F.lit(-300.0))))).otherwise(rare)


SCANNED = "oid long, th long, held_out boolean, n_tokens long, n_bytes long, base double, model double, known long, hs array<long>, ns array<int>"


def _scan(shared):
    """Texts with the worth of their coded bits and of the escaped tokens that every task knows; all others by hash and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, coded, index, codes, tables, weights, counts, spelled = pickle.loads(shared.value)
        mixer = Mixer(codes, tables, weights)
        base = model.base(counts)
        for batch in batches:
            at, held_out = 0, np.asarray(batch.column(2).to_pylist(), dtype=bool)
            for group in common.text_groups(batch.column(3), GROUP_BYTES):
                learned = ~held_out[at : at + len(group)]
                hashes, sizes = streams(group)
                place = index(hashes)
                text = np.repeat(np.arange(len(group)), sizes)
                symbols = np.where((place >= 0) & (place < coded), place, coded)
                total = mixer.score(hashes, sizes, symbols, learned)
                there = place >= 0
                sums = lambda values, at=text[there], n=len(group): np.bincount(at, weights=values, minlength=n)
                bases, known = sums(base[place[there]]), sums(counts[place[there]] > 0)
                # Escaped tokens once a text, with their number: a training text's own counts are left out.
                own = text[place >= coded].astype(np.int64) * len(counts) + place[place >= coded]
                own, n = np.unique(own, return_counts=True)
                of, which = own // len(counts), own % len(counts)
                worth = model.worth(counts[which] - n * learned[of], spelled[which])
                total += np.bincount(of, weights=n * worth, minlength=len(group))
                rare, of = hashes[~there], text[~there]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                fresh = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (of[1:] != of[:-1]))[: len(rare)])
                edges = pa.array(np.searchsorted(of[fresh], np.arange(len(group) + 1)).astype(np.int32))
                n = np.diff(fresh, append=len(rare)).astype(np.int32)
                ids = [c.slice(at, len(group)) for c in batch.columns[:3]]
                at += len(group)
                numbers = [
                    pa.array(sizes, pa.int64()), pa.array([len(t) for t in group], pa.int64()), pa.array(bases), pa.array(total),
                    pa.array(known.astype(np.int64))
                ]
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (common.signed(rare[fresh]), n)]
                yield pa.RecordBatch.from_arrays([*ids, *numbers, *lists], names=common.names_of(SCANNED))

    return run


def _spell_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, weights = pickle.loads(shared.value)
        speller = Speller(tables, weights)
        for batch in batches:
            spelled = speller.spell(common.raw_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spelled)], names=["h", "c", "spelled"])

    return run


def gather(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The texts (oid, th, held_out, text), and all their words with counts in training texts and in all."""
    held_out = (common.row_bucket(key, 10) == 0).alias("held_out")
    source = docs.select(common.order_id(key).alias("oid"), F.xxhash64(F.col(text)).alias("th"), held_out, F.col(text).alias("text"))
    counted = common.map_batches(source.select("held_out", "text"), _count_batches, "token binary, c long, c_all long")
    words = counted.groupBy("token").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))
    return source, common.materialize(common.map_batches(words, _hash_batches, "token binary, h long, c long, c_all long"))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of docs: oid, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    source, words = gather(docs, text, key)
    session = docs.sparkSession.sparkContext
    model = Model(source, words)
    shared, letters = model.shared, model.letters
    model.shared = model.letters = None
    scanned = session.broadcast(cloudpickle.dumps((model, model.coded, *shared)))
    del shared
    rows = common.materialize(common.map_batches(source.select("oid", "th", "held_out", "text"), _scan(scanned), SCANNED))
    scanned.unpersist()

    # All other words are joined by hash.
    least = least_count(words, HEAD)
    rest = words.filter(F.col("c_all") < least).select("token", "h", "c")
    spelling = session.broadcast(cloudpickle.dumps(letters))
    worth = common.map_batches(rest, _spell_batches(spelling), "h long, c long, spelled double")
    slim = rows.select("oid", "th", "held_out", "n_tokens", "n_bytes", "base", "model", "known")
    rare = rows.select("oid", "th", "held_out", F.explode(F.arrays_zip("hs", "ns")).alias("e"))
    rare = rare.select("oid", "th", F.col("e.hs").alias("h"), F.col("e.ns").alias("n"), F.expr("if(held_out, 0, e.ns)").alias("own"))
    joined = rare.join(worth, "h").withColumn("worth", model.worth_column("c - own", "spelled"))
    scale = F.lit(float(np.log10(max(model.n + 0.1 * (model.v + 1), 0.1))))
    tails = joined.groupBy("oid", "th").agg(
        F.sum(F.col("n") * F.col("worth")).alias("t_model"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) - scale)).alias("t_base"),
        F.sum(F.expr("if(c > 0, n, 0)")).alias("t_known"),
    )
    # Rows equal in id and text each bring their rare tokens; a row's share is the sum over their number.
    tails = tails.join(slim.groupBy("oid", "th").agg(F.count("*").alias("m")), ["oid", "th"])
    found = slim.join(tails, ["oid", "th"], "left")
    share = lambda own, more: F.col(own) + F.coalesce(F.col(more) / F.col("m"), F.lit(0.0))
    return found.select(
        "oid", "held_out", "n_tokens", F.round(share("known", "t_known")).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        share("base", "t_base").alias("base_score"), share("model", "t_model").alias("score"), "n_bytes",
    )


def op2(spark, sf_dir: str) -> DataFrame:
    rows = score(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))
    return rows.select(
        F.nullif(F.col("oid"), F.lit(2**63 - 1)).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"),
    )
