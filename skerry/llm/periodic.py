"""Periodic runs of words, in linear time over an ordered alphabet.

A run is a stretch of consecutive words with smallest period q that cannot be extended either way with that period; those
of at least LEAST words and TIMES periods count. The alphabet is the words of a text in the order in which they first
occur, compared by number: no suffix structure is built and nothing is hashed to compare words.

`next_smaller` goes through a text once and keeps a stack of suffixes, each smaller than all behind it. A word's suffix
pops the larger ones and so is their next smaller suffix: between both lies a Lyndon word, the longest one that starts
there (the Lyndon array). How far two suffixes agree is taken from what was matched before: from the two links that meet
in the suffix popped last, or, inside the stretch that the furthest reaching match covers, from the same pair one match
further left. So only words beyond that stretch are compared, each once. Every run has a Lyndon root that is the longest
one at its start in one of the two orders (the alphabet's and its reverse); the first such root of a run is extended to
the left by less than a period.

Every word of a run with three periods occurs in it three times. So a text is cut, without loss, at words that occur
twice or less in their stretch, and stretches of less than LEAST words need no search.

Null texts have no words; an empty table gives an empty one; rows equal in id and text get equal values; other columns
stay, and the new one's name ends in underscores where it would clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, TIMES = 24, 3
Run = tuple[int, int, int]
"""Start, length, period."""


def next_smaller(word: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the start of the next smaller one and how many words both share. word ends with a sentinel that is
    smaller than all and occurs once."""
    n = len(word) - 1
    smaller, shared = [n] * n, [0] * n
    before, shared_before = [-1] * (n + 1), [0] * (n + 1)
    left = right = reach = 0  # the match that reaches furthest
    for r in range(1, n + 1):
        at, same = r - 1, 0
        while True:
            if r + same < reach and at >= right:  # the same pair one match further left has been compared
                x, y = at - right + left, r - right + left
                if smaller[x] == y:
                    same = shared[x]
                elif before[y] == x:
                    same = shared_before[y]
                if same >= reach - r:
                    same = reach - r
                    while word[at + same] == word[r + same]:
                        same += 1
            else:
                while word[at + same] == word[r + same]:
                    same += 1
            if r + same >= reach:
                left, right, reach = at, r, r + same
            if word[at + same] < word[r + same]:
                before[r], shared_before[r] = at, same
                break
            while True:
                smaller[at], shared[at] = r, same
                kept, at = shared_before[at], before[at]
                if at < 0 or same >= kept:  # with less in common than the two on the stack, the next one is larger too
                    break
            if at < 0:
                break
            if same > kept:
                before[r], shared_before[r] = at, kept
                break
    return smaller, shared


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The runs of a sequence of numbers, by start, then period."""
    found, n = set(), len(codes)
    for own in (codes, codes.max(initial=0) - codes):
        word = [*own.tolist(), -1]
        smaller, shared = (np.array(x, dtype=np.int64) for x in next_smaller(word))
        period = smaller - np.arange(n)
        for at in np.flatnonzero(shared > (times - 2) * period).tolist():
            q = int(period[at])
            if at >= q and smaller[at - q] == at and shared[at - q] >= q:
                continue  # not the first root of its run
            back = 0
            while back < at and word[at - 1 - back] == word[at + q - 1 - back]:
                back += 1
            length = back + q + int(shared[at])
            if length >= max(least, times * q):
                found.add((at - back, length, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _stretches(codes: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """Start and end of the stretches of at least so many words in which each word occurs `times` times."""
    todo = [(0, len(codes))]
    while todo:
        start, end = todo.pop()
        own = codes[start:end]
        if end - start < len(codes):
            own = np.unique(own, return_inverse=True)[1]
        often = (np.bincount(own) >= times)[own]
        if often.all():
            yield start, end
            continue
        edges = np.flatnonzero(np.diff(often, prepend=False, append=False))
        todo += [(start + a, start + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


def runs_of_words(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The runs of a sequence of words, by start, then period."""
    if len(words) < max(least, times):
        return []
    codes = np.asarray(pa.array(words, pa.large_binary()).dictionary_encode().indices).astype(np.int64)
    found = [(a + s, n, q) for a, b in _stretches(codes, max(least, times), times) for s, n, q in runs_of(codes[a:b], least, times)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with the column runs: all runs of each text, by start, then period."""
    (out,) = common.free_names(docs, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            for at, n in common.row_groups(last):
                found = [
                    [dict(zip(("start", "length", "period"), x, strict=True)) for x in runs_of_words(t.split(), least, times)]
                    for t in common.raw_bytes(last.slice(at, n))
                ]
                kept = [c.slice(at, n) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, _RUNS)], names=[*batch.schema.names, out])

    own = common.with_last(docs, text)
    return common.as_before(common.map_batches(own, run, f"{common.ddl(own)}, `{out}` {RUNS}"), docs, out)


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with one period of each run: the words after it go, with the white space before them. Null stays null, and texts
    without a run stay byte for byte."""
    word = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")

    def shorter(t: bytes) -> bytes:
        words = t.split()
        runs = runs_of_words(words, least, times)
        if not runs:
            return t
        gone = dropped(len(words), runs).tolist()
        return b"".join(w for w, g in zip(word.findall(t), gone, strict=True) if not g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            for at, n in common.row_groups(last):
                own = last.slice(at, n)
                texts = [shorter(t) if ok else None for t, ok in zip(common.raw_bytes(own), own.is_valid().to_pylist(), strict=True)]
                kept = [c.slice(at, n) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary()).cast(pa.string())], names=batch.schema.names)

    own = common.with_last(docs, text)
    return common.as_before(common.map_batches(own, run, common.ddl(own)), docs)


OP11 = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _digest(words: list[bytes], h: int) -> tuple:
    """The columns of op11 behind doc_id; h is the checksum of the id, which decides whether the text is made periodic."""
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        unit = words[a : a + p]
        words = [*words[:a], *(unit * (-(-(n - a) // p)))[: n - a]]
    runs = runs_of_words(words)
    top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    kept = [w for w, gone in zip(words, dropped(n, runs).tolist(), strict=True) if not gone] if runs else words
    milli = 1000 * top[1] // top[2] if runs else None
    return len(runs), *top, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def op11(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in OP11.split(", ")])
        for batch in batches:
            for at, n in common.row_groups(batch.column(2)):
                ids, sums = (batch.column(k).slice(at, n).to_pylist() for k in (0, 1))
                found = [(i, *_digest(t.split(), h)) for i, h, t in zip(ids, sums, common.raw_bytes(batch.column(2).slice(at, n)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema
                )

    return common.map_batches(rows, run, OP11)


# Four words in a row that stand again q words further on; stretches of such places are stretches with period q, less three words.
ORACLE = f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM (SELECT unnest(range(256)) AS i) UNION ALL
       SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM bits WHERE k < 8),
     crc(doc_id, s, at_byte, c) AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents UNION ALL
       SELECT doc_id, s, at_byte + 1, xor(crc.c >> 8, b.c) FROM crc JOIN bits AS b ON b.k = 8 AND b.i = xor(crc.c % 256, CAST(ascii(substr(s, at_byte + 1, 1)) AS BIGINT))
       WHERE at_byte < length(s)),
     h AS (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS h FROM crc WHERE at_byte = length(s)),
     d AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents JOIN h USING (doc_id)),
     e AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM d),
     f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
     t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM f),
     r4 AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 4], ' ') AS x FROM (SELECT *, unnest(range(n - 3)) AS i FROM t WHERE n >= {LEAST})),
     pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM r4 AS x JOIN r4 AS y ON y.doc_id = x.doc_id AND y.x = x.x AND y.i > x.i AND {TIMES} * (y.i - x.i) <= x.n),
     lines AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS line FROM pairs),
     found AS (SELECT doc_id, min(i) AS start, count(*) + 3 + q AS length, q FROM lines GROUP BY doc_id, q, line),
     runs AS (SELECT doc_id, start, length, min(q) AS period FROM found WHERE length >= greatest({LEAST}, {TIMES} * q) GROUP BY ALL),
     top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
     listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY doc_id),
     words AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM t JOIN listed USING (doc_id))),
     gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS said FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed.said, '')) AS runs_sha256,
       sha256(coalesce(kept.said, array_to_string(w, ' '))) AS collapsed_sha256
FROM t LEFT JOIN listed USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
