"""Substring dedup by level-wise doubling.

A word is removed where a window of LENGTH words covers it whose words also start, in the same order, in a document
with a smaller id. Levels: windows of half the length come first. Of every LENGTH consecutive words the half-length
window with the least hash is taken, which is the same one wherever those words stand, so no repeated window is
missed though only a fraction of the half-length ones is compared. Half-length windows found in two different
documents alone are extended to LENGTH words and compared again; `longest` goes on doubling until none survives.

Documents with equal word sequences form a class; its representative has the smallest id. The others' windows all
start in the representative, so they are removed whole (if they have a window at all), and only representatives are
compared. Null ids are larger than all others, null texts have no words. Rows equal in id and text are judged alike,
neither removes the other. Comparisons are by 64-bit hashes of word sequences, classes by 128 bits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 50
SEEN = 1_000_000
WORD = rb"[^\x20\x09-\x0D]+"


def _least(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashes of the half-length windows, the least of each window's, and how many of them a window has."""
    half = length // 2
    own = common.window_hashes(hashes, half)
    return own, common.sliding_minima(own, length - half + 1), length - half + 1


def anchors(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the half-length windows that are the least of some window of a document, in order."""
    own, least, span = _least(hashes, length)
    if not len(least):
        return own[:0], np.empty(0, dtype=np.int64)
    edge = np.zeros(span - 1, dtype=np.uint64)
    greatest = ~common.sliding_minima(~np.concatenate([edge, least, edge]), span)  # of the minima of the windows around
    at = np.flatnonzero(own == greatest)
    return own[at], at


def starts_of(hashes: np.ndarray, length: int, kept: np.ndarray) -> np.ndarray:
    """Starts of the windows whose least half-length window is among the positions kept."""
    own, least, span = _least(hashes, length)
    among = np.full(len(own), np.iinfo(np.uint64).max, dtype=np.uint64)
    among[kept] = own[kept]
    return np.flatnonzero(common.sliding_minima(among, span) == least)


SURVEY = "oid long, th long, n_words long, s1 long, s2 long, all_sha string, hs array<long>, ps array<int>"


def _survey(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at = 0
            for group in common.text_groups(batch.column(2)):
                n, s1, s2, sha, hs, ps = [], [], [], [], [], []
                for text in group:
                    words = text.split()
                    joined = b" ".join(words)
                    digest = xxhash.xxh3_128_digest(joined)
                    n.append(len(words))
                    s1.append(int.from_bytes(digest[:8], "little", signed=True))
                    s2.append(int.from_bytes(digest[8:], "little", signed=True))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    if len(words) < length or digest in seen:
                        h, p = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
                    else:
                        if len(seen) < SEEN:
                            seen.add(digest)
                        h, p = anchors(common.word_hashes(joined), length)
                    hs.append(common.signed(h))
                    ps.append(p)
                ids = [batch.column(k).slice(at, len(group)) for k in (0, 1)]
                at += len(group)
                numbers = [pa.array(x, pa.int64()) for x in (n, s1, s2)]
                lists = [common.int_lists(hs, pa.int64(), np.int64), common.int_lists(ps, pa.int32(), np.int32)]
                yield pa.RecordBatch.from_arrays([*ids, *numbers, pa.array(sha, pa.string()), *lists], names=common.names_of(SURVEY))

    return run


def _extend(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ps = [], []
            for text, kept in zip(common.raw_bytes(batch.column(2)), common.list_parts(batch.column(3), np.int64), strict=True):
                words = common.word_hashes(text)
                at = starts_of(words, length, kept)
                hs.append(common.signed(common.window_hashes(words, length)[at]))
                ps.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], common.int_lists(hs, pa.int64(), np.int64), common.int_lists(ps, pa.int32(), np.int32)],
                names=["oid", "th", "hs", "ps"]
            )

    return run


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words some window covers."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + length, n), -1)
    return np.cumsum(edges[:n]) > 0


class Repeats:
    """What repeats in docs. meta: a row per row of docs (oid, th, n_words, all_sha, first: whether it represents its
    class); marks: oid, th, starts of the windows to remove. Texts are read again where they are needed, never kept."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> None:
        source = docs.select(common.order_id(key).alias("oid"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
        self.source = source
        survey = common.materialize(common.map_batches(source, _survey(length), SURVEY))
        classes = common.materialize(survey.groupBy("s1", "s2").agg(F.min(F.struct("oid", "th")).alias("rep")))
        meta = survey.select("oid", "th", "n_words", "s1", "s2", "all_sha").join(classes, ["s1", "s2"])
        self.meta = meta.select("oid", "th", "n_words", "all_sha", (F.col("oid") == F.col("rep.oid")).alias("first"))

        # Half length: what stands in two different word sequences survives.
        halves = survey.select("s1", "s2", F.explode(F.arrays_zip("hs", "ps")).alias("a")).select(
            "s1", "s2", F.col("a.hs").alias("h"), F.col("a.ps").alias("p")
        )
        alive = halves.groupBy("h").agg(F.min("s1").alias("least"), F.max("s1").alias("most")).filter("least <> most").select("h")
        alive = common.materialize(alive)
        kept = halves.join(alive, "h").groupBy("s1", "s2").agg(F.sort_array(F.collect_set("p")).alias("kept"))
        kept = common.materialize(kept.join(classes, ["s1", "s2"]).select(F.col("rep.oid").alias("oid"), F.col("rep.th").alias("th"), "kept"))

        # Full length: the windows around them.
        texts = self.texts_of(kept).select("oid", "th", "text", "kept")
        candidates = common.materialize(common.map_batches(texts, _extend(length), "oid long, th long, hs array<long>, ps array<int>"))
        windows = candidates.select("oid", "th", F.explode(F.arrays_zip("hs", "ps")).alias("a")).select(
            "oid", "th", F.col("a.hs").alias("h"), F.col("a.ps").alias("p")
        )
        self.shared = self._shared(windows)
        self.marks = common.materialize(self.shared.filter("least < oid").groupBy("oid", "th").agg(F.collect_list("p").alias("starts")))

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """wanted (oid, th and other columns, materialized) with text, once for rows that are equal in id and text."""
        return common.pick(self.source, wanted, ["oid", "th"]).join(wanted, ["oid", "th"]).dropDuplicates(["oid", "th"])

    @staticmethod
    def _shared(windows: DataFrame) -> DataFrame:
        """The windows (oid, th, h, p) that start in two ids, with the least of these."""
        firsts = windows.groupBy("h").agg(F.min("oid").alias("least"), F.max("oid").alias("most")).filter("least < most")
        return windows.join(common.materialize(firsts.select("h", "least")), "h")


def longest(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """oid, longest: for representatives with removals the greatest length * 2^k of a window that starts in a smaller id too.

    Windows of one level that survive, in whichever documents, and stand end to end are extended to twice the length,
    level by level, until no candidate survives.
    """
    found = Repeats(docs, text, key, length)
    out, size, shared = None, length, common.materialize(found.shared)
    while shared.limit(1).count():
        level = shared.filter("least < oid").select("oid", F.lit(size).alias("longest")).distinct()
        out = level if out is None else out.unionByName(level)
        size *= 2
        starts = common.materialize(shared.groupBy("oid", "th").agg(F.collect_list("p").alias("starts")))
        texts = found.texts_of(starts).select("oid", "th", "text", "starts")
        rows = common.map_batches(texts, _windows_at(size), "oid long, th long, h long, p int")
        shared = common.materialize(Repeats._shared(common.materialize(rows)))
    none = docs.sparkSession.createDataFrame([], "oid long, longest int")
    return (none if out is None else out).groupBy("oid").agg(F.max("longest").alias("longest"))


def _rows(batch: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(p) for _, p in found]
    ids = [np.repeat(np.asarray(batch.column(k)), sizes) for k in (0, 1)]
    h = np.concatenate([common.signed(x) for x, _ in found]) if found else np.empty(0, dtype=np.int64)
    p = np.concatenate([x for _, x in found]) if found else np.empty(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), pa.array(h, pa.int64()), pa.array(p.astype(np.int32))],
        names=["oid", "th", "h", "p"]
    )


def _windows_at(size: int):
    """Windows of size words whose two halves both were repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, starts in zip(common.raw_bytes(batch.column(2)), common.list_parts(batch.column(3), np.int64), strict=True):
                own = common.window_hashes(common.word_hashes(text), size)
                at = np.unique(starts[np.isin(starts + size // 2, starts)])
                at = at[at < len(own)]
                found.append((own[at], at))
            yield _rows(batch, found)

    return run


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """docs, all columns, without the repeated words. Texts that lose nothing stay as they are; others keep the white space
    before each word that stays."""
    found = Repeats(docs, text, key, length)
    oid, th, mark, n, first, starts = common.free_names(docs, "_oid", "_th", "_mark", "_n", "_first", "_starts")
    decided = found.meta.groupBy("oid", "th").agg(F.first("n_words").alias(n), F.first("first").alias(first)).join(found.marks, ["oid", "th"], "left")
    decided = decided.withColumnsRenamed({"oid": oid, "th": th, "starts": starts}).filter(f"{starts} is not null or (not {first} and {n} >= {length})")
    decided = decided.select(oid, th, F.when(~F.col(first), F.array(F.lit(-1))).otherwise(F.col(starts)).alias(mark))
    rows = docs.withColumns({oid: common.order_id(key), th: F.xxhash64(F.col(text))}).join(decided, [oid, th], "left")
    rest = [c for c in docs.columns if c != text]
    own = rows.select(*(F.col(f"`{c}`") for c in (*rest, text)), mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(rb"[\x20\x09-\x0D]*" + WORD)
        for batch in batches:
            given, marked = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            out = []
            for t, starts in zip(given.cast(pa.binary()).to_pylist(), common.list_parts(marked, np.int64), strict=True):
                if t is None or not len(starts):
                    out.append(t)
                elif starts[0] < 0:
                    out.append(b"")
                else:
                    words = word.findall(t)
                    gone = covered(len(words), starts, length)
                    out.append(b"".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.binary()).cast(pa.string())], names=batch.schema.names[:-1])

    return common.map_batches(own, run, common.ddl(own.drop(mark))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = Repeats(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text, starts in zip(common.raw_bytes(batch.column(2)), common.list_parts(batch.column(3), np.int64), strict=True):
                words = text.split()
                gone = covered(len(words), starts, LENGTH)
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sha)], names=["oid", "th", "gone", "kept"])

    texts = found.texts_of(found.marks).select("oid", "th", "text", "starts")
    cut = common.map_batches(texts, run, "oid long, th long, gone long, kept string")
    rows = found.meta.join(cut, ["oid", "th"], "left")
    whole = (F.col("n_words") >= LENGTH) & ~F.col("first")
    return rows.select(
        F.nullif(F.col("oid"), F.lit(2**63 - 1)).alias("doc_id"), "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "all_sha")).alias("kept_sha256"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     g AS (SELECT doc_id, i AS p, md5(array_to_string(w[i : i + {LENGTH - 1}], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH})),
     m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM g),
     c AS (SELECT doc_id, list(DISTINCT p) AS starts FROM m WHERE least < doc_id GROUP BY doc_id),
     x AS (SELECT doc_id, i, w[i] AS word, coalesce(len(list_filter(starts, lambda s: s <= i AND i < s + {LENGTH})) > 0, FALSE) AS gone FROM (SELECT d.doc_id, w, starts, unnest(range(1, len(w) + 1)) AS i FROM d JOIN c USING (doc_id))),
     k AS (SELECT doc_id, count(*) FILTER (gone) AS n_gone, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
