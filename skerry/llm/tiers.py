"""Ranked lexical search over a tiered index, exact.

The index has a row a document, with the postings of the terms that the items use as one pair of columns a tier: those of
high impact (what a term adds for its weight, by frequency and length) in the first, the next in the second, the rest in
the third. A term's tiers are cut at impacts, so what a lower tier can add is bounded by the cut: the term's residual. As
a tier is a pair of Parquet columns, a search reads those tiers alone that it needs.

A search goes from tier to tier. For each item it finds the K best sums over the tiers read so far; the K-th is the floor.
A document that no tier read so far names scores at most the sum of the item's residuals. Where that is below the floor,
the answer is proven to lie among the documents whose sum, with the residuals of the terms they were not seen with, reaches
the floor: these are scored exactly, over all tiers, and the item is done. All other items fall through to the next tier;
behind the last one no residual is left. So where the cuts lie decides about time only, never about the result: they are
estimated from about SAMPLE documents, picked by hash; weights and counts are those of all documents.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased; null texts have none. Items are
searched in blocks whose terms make up to about BLOCK pairs of term and item, so what is sent to each task has a bound; one
item's own terms are its least. Equal scores go by document id, null ids last; ids are integers. Each row of documents is a
document and each row of items an item, rows that repeat as well. No documents or no items, no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 10
TIERS = ((4096, 16), (32768, 4))
"""For each tier but the last: a term's postings down to it, at least so many and at least one in so many."""
SAMPLE = 8192
BLOCK = 1 << 20
CELLS = 1 << 21
"""Sums (of a document for an item) and parts of them that a task holds at a time."""
_SPACED = bytes(x if chr(x).isascii() and chr(x).isalnum() or x > 127 else 32 for x in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


def weight(documents: int, df: int) -> int:
    """What a term that df documents hold weighs."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What terms that occur tf times add in documents of n terms, for a weight of 1."""
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n * documents // total))


class Block:
    """The items searched together: their terms by number, and for each term its items."""

    def __init__(self, pairs: pa.Table) -> None:
        found = pairs["term"].combine_chunks().dictionary_encode()
        self.terms: list[bytes] = found.dictionary.to_pylist()
        self.rows, items = np.unique(pairs["iid"].to_numpy(), return_inverse=True)
        order = np.argsort(np.asarray(found.indices), kind="stable")
        self.items, self.of = items[order], np.asarray(found.indices)[order]
        self.weight = np.zeros(len(self.terms), dtype=np.int64)
        self.residual = np.zeros((len(TIERS) + 1, len(self.terms)), dtype=np.int64)
        self.cut = np.zeros((len(TIERS), len(self.terms)), dtype=np.int64)

    def search_for(self, active: np.ndarray) -> None:
        """From now on only these items are looked for."""
        keep = active[self.items]
        self.found = self.items[keep]
        self.degree = np.bincount(self.of[keep], minlength=len(self.terms))
        self.first = np.cumsum(self.degree) - self.degree

    def rest(self, tier: int) -> np.ndarray:
        """What a document that the tiers up to this one do not name can score at most, by item."""
        most = np.zeros(len(self.rows), dtype=np.int64)
        np.add.at(most, self.items, (self.weight * self.residual[tier])[self.of])
        return most

    def sums(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """For n documents (rows) and all items (columns) the sum of value, given by owner (a row's number) and term."""
        each = self.degree[term]
        part = np.repeat(np.arange(len(term)), each)
        place = self.first[term][part] + np.arange(len(part)) - np.repeat(np.cumsum(each) - each, each)
        cell = owner[part] * len(self.rows) + self.found[place]
        own = value[part]
        if np.abs(own).sum(dtype=np.float64) < 2.0**52:
            flat = np.bincount(cell, weights=own, minlength=n * len(self.rows)).astype(np.int64)
        else:
            flat = np.zeros(n * len(self.rows), dtype=np.int64)
            np.add.at(flat, cell, own)
        return flat.reshape(n, len(self.rows))


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value.terms)}
        for batch in batches:
            for at, n in common.row_groups(batch.column(1)):
                sizes, ids, tfs = [], [], []
                for text in common.raw_bytes(batch.column(1).slice(at, n)):
                    words = terms(text)
                    own = np.array([x for x in map(number.get, words) if x is not None], dtype=np.int32)
                    own, times = np.unique(own, return_counts=True)
                    sizes.append(len(words)), ids.append(own), tfs.append(times)
                arrays = [pa.array(sizes, pa.int64()), common.int_lists(ids, pa.int32(), np.int32), common.int_lists(tfs, pa.int32(), np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *arrays], names=["oid", "n", "ids", "tfs"])

    return run


def _columns(tier: int) -> tuple[str, str]:
    return f"ids{tier}", f"values{tier}"


INDEX = "row long, oid long, " + ", ".join(f"{a} array<int>, {b} array<int>" for a, b in map(_columns, range(len(TIERS) + 1)))


def _tiered(shared, documents: int, total: int):
    """Rows (row, oid, n, ids, tfs) as rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value.cut
        for batch in batches:
            ids, tfs = (common.list_parts(batch.column(k), np.int64) for k in (3, 4))
            out: list[list] = [[] for _ in range(2 * (len(TIERS) + 1))]
            for n, own, tf in zip(batch.column(2).to_pylist(), ids, tfs, strict=True):
                value = impacts(tf, np.full(len(tf), n), documents, max(total, 1))
                tier = (value < cut[:, own]).sum(axis=0)
                for t in range(len(TIERS) + 1):
                    out[2 * t].append(own[tier == t])
                    out[2 * t + 1].append(value[tier == t])
            lists = [common.int_lists(x, pa.int32(), np.int32) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=common.names_of(INDEX))

    return run


def _groups(batch: pa.RecordBatch, first: int, block: Block) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Start and number of rows of groups of documents, with owner (from 0), term and value of their postings, so that a group
    makes up to CELLS sums and parts, or is one document. first: the column where the tiers begin."""
    lists = [common.list_parts(batch.column(k), np.int64) for k in range(first, batch.num_columns)]
    ids = [np.concatenate(x) for x in zip(*lists[::2], strict=True)]
    values = [np.concatenate(x) for x in zip(*lists[1::2], strict=True)]
    parts = np.cumsum([max(int(block.degree[x].sum()), len(block.rows)) for x in ids])
    at = 0
    while at < len(ids):
        before = parts[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(parts, before + CELLS, side="right")))
        owner = np.repeat(np.arange(end - at), [len(x) for x in ids[at:end]])
        yield at, end - at, owner, np.concatenate(ids[at:end]), np.concatenate(values[at:end])
        at = end


TOP = "item int, score long, oid long"


def _best(shared, k: int):
    """The k best sums of each item in a task, over the tiers that the rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        kept = np.empty((3, 0), dtype=np.int64)
        floor = np.ones(len(block.rows), dtype=np.int64)
        for batch in batches:
            ids = np.asarray(batch.column(1))
            for at, n, owner, term, value in _groups(batch, 2, block):
                sums = block.sums(owner, term, block.weight[term] * value, n)
                doc, item = np.nonzero(sums >= floor)
                kept = np.concatenate([kept, np.stack([item, sums[doc, item], ids[at + doc]])], axis=1)
                kept = kept[:, np.lexsort((kept[2], -kept[1], kept[0]))]
                start = np.searchsorted(kept[0], kept[0])
                rank = np.arange(kept.shape[1]) - start
                last = rank == k - 1
                floor[kept[0, last]] = kept[1, last]
                kept = kept[:, rank < k]
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[1]), pa.array(kept[2])], names=common.names_of(TOP))

    return run


def _may(shared, tier: int, floor: np.ndarray):
    """Rows (row, item) of the documents that may still reach the floor of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        rest = block.rest(tier)
        for batch in batches:
            rows = np.asarray(batch.column(0))
            for at, n, owner, term, value in _groups(batch, 2, block):
                gain = block.sums(owner, term, block.weight[term] * (value - block.residual[tier][term]), n)
                doc, item = np.nonzero(gain + rest >= floor)
                yield pa.RecordBatch.from_arrays([pa.array(rows[at + doc]), pa.array(item.astype(np.int32))], names=["row", "item"])

    return run


def _exact(shared):
    """Rows (wanted items, oid and all tiers) as TOP, with the whole scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            wanted, ids = common.list_parts(batch.column(0), np.int64), np.asarray(batch.column(1))
            for at, n, owner, term, value in _groups(batch, 2, block):
                sums = block.sums(owner, term, block.weight[term] * value, n)
                doc = np.repeat(np.arange(n), [len(x) for x in wanted[at : at + n]])
                item = np.concatenate(wanted[at : at + n])
                arrays = [pa.array(item.astype(np.int32)), pa.array(sums[doc, item]), pa.array(ids[at + doc])]
                yield pa.RecordBatch.from_arrays(arrays, names=common.names_of(TOP))

    return run


class Search:
    """A search of one block of items. log: for each tier how many items came to it and how many were proven there."""

    def __init__(self, source: DataFrame, block: Block, folder: str, k: int) -> None:
        self.spark, self.block, self.k, self.folder = source.sparkSession, block, k, folder
        self.source = source
        self.log: list[tuple[int, int]] = []

    def _send(self, fn, rows: DataFrame, schema: str, *more) -> DataFrame:
        return common.map_batches(rows, fn(self.spark.sparkContext.broadcast(self.block), *more), schema)

    def index(self) -> DataFrame | None:
        """The index, written as Parquet; None without documents."""
        found = self._send(_postings, self.source, "oid long, n long, ids array<int>, tfs array<int>")
        found.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{self.folder}/postings")
        postings = self.spark.read.parquet(f"{self.folder}/postings")
        documents, total = postings.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not documents:
            return None
        block, share = self.block, -(-documents // SAMPLE)
        counted = postings.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()
        df = np.zeros(len(block.terms), dtype=np.int64)
        df[counted["id"].to_numpy()] = counted["count"].to_numpy()
        block.weight = np.array([weight(documents, int(x)) for x in df], dtype=np.int64)
        sampled = postings.filter(f"n > 0 and pmod(xxhash64(row), {share}) = 0").select("n", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
        sampled = sampled.select("p.ids", "p.tfs", "n").toArrow()
        value = impacts(sampled["tfs"].to_numpy(), sampled["n"].to_numpy(), documents, total)
        order = np.lexsort((-value, sampled["ids"].to_numpy()))
        value, many = value[order], np.bincount(sampled["ids"].to_numpy(), minlength=len(block.terms))
        start = np.cumsum(many) - many
        for tier, (least, one_in) in enumerate(TIERS):
            kept = np.minimum(1.0, np.maximum(least / np.maximum(df, 1), 1 / one_in))
            rank = np.ceil(kept * many).astype(np.int64) - 1
            whole = (kept >= 1) | (many == 0)
            block.cut[tier] = np.where(whole, 0, value[np.where(whole, 0, start + rank)] if len(value) else 0)
            block.residual[tier] = np.maximum(block.cut[tier] - 1, 0)
        rows = postings.select("row", "oid", "n", "ids", "tfs").filter("size(ids) > 0")
        self._send(_tiered, rows, INDEX, documents, total).write.parquet(f"{self.folder}/index")
        return self.spark.read.parquet(f"{self.folder}/index")

    def _ranked(self, found: DataFrame) -> DataFrame:
        """The k best rows of TOP of each item, with rank."""
        order = Window.partitionBy("item").orderBy(F.desc("score"), "oid")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def run(self) -> DataFrame | None:
        """item, rank, oid, score of each item of the block (by its number); None without documents."""
        index, block, answers = self.index(), self.block, []
        if index is None:
            return None
        left = np.ones(len(block.rows), dtype=bool)
        for tier in range(len(TIERS) + 1):
            block.search_for(left)
            names = [c for t in range(tier + 1) for c in _columns(t)]
            some = " or ".join(f"size({c}) > 0" for c in names[::2])
            rows = index.select("row", "oid", *names).filter(some)
            best = self._ranked(self._send(_best, rows, TOP, self.k))
            if tier == len(TIERS):
                self.log.append((int(left.sum()), int(left.sum())))
                answers.append(best)
                break
            floors = best.filter(F.col("rank") == self.k).select("item", "score").toArrow()
            floor = np.zeros(len(block.rows), dtype=np.int64)
            floor[floors["item"].to_numpy()] = floors["score"].to_numpy()
            proven = left & (block.rest(tier) < floor)
            self.log.append((int(left.sum()), int(proven.sum())))
            if proven.any():
                block.search_for(proven)
                floor[~proven] = np.iinfo(np.int64).max
                may = self._send(_may, rows, "row long, item int", tier, floor).groupBy("row").agg(F.collect_list("item").alias("items"))
                may = common.materialize(may)
                whole = common.pick(index, may, ["row"]).join(may, "row").select(
                    "items", "oid", *(c for t in range(len(TIERS) + 1) for c in _columns(t))
                )
                answers.append(common.materialize(self._ranked(self._send(_exact, whole, TOP).filter("score > 0"))))
            left &= ~proven
            if not left.any():
                break
        out = answers[0]
        for more in answers[1:]:
            out = out.unionByName(more)
        return common.materialize(out)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(dict.fromkeys(terms(t))) for t in common.raw_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["iid", "terms"])


def search(
    docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    log: list | None = None
) -> DataFrame:
    """item_key, rank, key and score of the k best documents with a score above 0 for each row of items."""
    spark = docs.sparkSession
    ids = [F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")]
    named = common.materialize(items.select(*ids).withColumn("iid", F.monotonically_increasing_id()))
    pairs = common.map_batches(named.select("iid", "text"), _terms_of, "iid long, terms array<binary>")
    pairs = common.materialize(pairs.select("iid", F.explode("terms").alias("term")))
    source = docs.select(common.order_id(key).alias("oid"), F.col(f"`{text}`").alias("text"))
    blocks, out = -(-pairs.count() // BLOCK), []
    for number in range(blocks):
        block = Block(pairs.filter(f"pmod(xxhash64(iid), {blocks}) = {number}").toArrow())
        if not block.terms:
            continue
        folder = f"{common.shared_dir(spark)}/tiers-{uuid.uuid4().hex}"
        try:
            one = Search(source, block, folder, k)
            found = one.run()
        finally:
            common.delete(spark, folder)
        if log is not None:
            log += one.log
        if found is not None:
            numbers = spark.createDataFrame(
                pa.table({"item": pa.array(np.arange(len(block.rows), dtype=np.int32)), "iid": pa.array(block.rows)})
            )
            out.append(found.join(numbers, "item").select("iid", "rank", "oid", "score"))
    if not out:
        found = spark.createDataFrame([], "iid long, rank int, oid long, score long")
    else:
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
    return found.join(named.select("iid", "item_id"), "iid").select(
        F.col("item_id").alias(item_key), "rank", F.nullif(F.col("oid"), F.lit(2**63 - 1)).alias(key), "score"
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
     c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
     p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
     q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
     f AS (SELECT doc_id, term, n, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
     i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)) AS v FROM f, c),
     s AS (SELECT item_id, doc_id, CAST(sum(w * v) AS BIGINT) AS score FROM q JOIN i USING (term) JOIN w USING (term) GROUP BY ALL HAVING sum(w * v) > 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
