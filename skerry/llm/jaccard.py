"""N-gram Jaccard join: exact links between sets of word shingles, and the components they form.

Shingles are ordered rare first by one global order: the logarithm of how often a shingle's slot was counted where
that is far above the mean, then the hash. Of a set with n shingles only the prefix of n - ceil(t n) + 1 is indexed.
Filters: sizes; position (what the first common prefix shingle leaves); suffix (a lower bound of the difference from
counts per hash range); pairs that pass are verified once on the whole sets.

Large groups of near copies cost no square. Every set is first verified against one centre: of the sets that lead one of
its prefix shingles' lists (a list is led by the set whose lists are longest in all) the one that leads most. What a set
has more or less than its centre is its difference; for two sets x and y of one centre, the symmetric difference of x and
y is that of their differences. So both are similar where their differences are small enough together, and then both are
similar to the centre too; all others need a common member of their differences, and are found by the same prefix join
over differences, rare members first. The join of the sets' own prefixes is left with pairs of different centres. No pair
is made inside what is connected already. Sets that are equal are one class from the start.

A text with fewer words than a shingle has its whole sequence as its one shingle; texts without words (and null texts)
have an empty set, linked with nothing. Null ids count as larger than all others. Rows equal in id and text are judged
alike. Sets are of 64-bit hashes; a class is told apart by 128 bits and named by 64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, PERCENT = 4, 85
SLOT_BITS = 20
HEAVY = 3
"""A slot is frequent in a task that counts it so many times the mean."""
RANGE_MEMBERS = 4
"""A set is counted in ranges of so many members or up to twice as many; unrelated sets of any size then differ by far."""
PART = 1024
"""So many sets that meet one other make a part; each part gets a copy of that other one."""
SEEN = 1_000_000
BROADCAST_ROWS = 500_000
"""Up to so many rows of three or four numbers (at most 32 bytes each) are broadcast, beyond it they are joined."""


def shingle_set(text: bytes, width: int) -> np.ndarray:
    words = common.word_hashes(text.lower())
    if not len(words):
        return words
    return np.unique(common.window_hashes(words, min(width, len(words))))


def range_counts(members: np.ndarray) -> np.ndarray:
    """How many members fall in each of a power of two of hash ranges (at most 255 counted, which only weakens the filter)."""
    bits = max(3, (len(members) // RANGE_MEMBERS).bit_length() - 1)
    return np.minimum(np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255)


def _slots(width: int):
    """Counts of the frequent slots of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask = np.zeros(1 << SLOT_BITS, dtype=np.int64), np.uint64((1 << SLOT_BITS) - 1)
        for batch in batches:
            for group in common.text_groups(batch.column(0)):
                sets = [shingle_set(t, width) for t in group]
                counts += np.bincount((np.concatenate(sets) & mask).astype(np.int64), minlength=1 << SLOT_BITS)
        heavy = np.flatnonzero(counts > HEAVY * counts.mean() + 4)
        yield pa.RecordBatch.from_arrays([pa.array(heavy, pa.int64()), pa.array(counts[heavy], pa.int64())], names=["slot", "n"])

    return run


def slot_ranks(source: DataFrame, width: int) -> np.ndarray:
    """A rank for each of the 2^SLOT_BITS slots: 0, or for a frequent one the logarithm of its count."""
    counted = common.map_batches(source.select("text"), _slots(width), "slot long, n long")
    found = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    ranks = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    if found.num_rows:
        ranks[found["slot"].to_numpy()] = 1 + np.log2(found["n"].to_numpy()).astype(np.uint8)
    return ranks


SURVEY = "oid long, th long, n long, s1 long, s2 long, toks array<long>, sketch binary"


def _survey(width: int, percent: int, shared):
    """A row a text; the prefix and the counts per hash range only for the first of equal sets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = shared.value, set()
        mask = np.uint64((1 << SLOT_BITS) - 1)
        for batch in batches:
            at = 0
            for group in common.text_groups(batch.column(2)):
                n, s1, s2, toks, sketch = [], [], [], [], []
                for text in group:
                    own = shingle_set(text, width)
                    digest = xxhash.xxh3_128_digest(own.tobytes())
                    n.append(len(own))
                    s1.append(int.from_bytes(digest[:8], "little", signed=True))
                    s2.append(int.from_bytes(digest[8:], "little", signed=True))
                    if not len(own) or digest in seen:
                        toks.append(own[:0].view(np.int64))
                        sketch.append(b"")
                        continue
                    if len(seen) < SEEN:
                        seen.add(digest)
                    rank = ranks[(own & mask).astype(np.int64)]
                    prefix = len(own) - -(-percent * len(own) // 100) + 1
                    toks.append(common.signed(own[np.argsort(rank, kind="stable")[:prefix]]))
                    sketch.append(range_counts(own).astype(np.uint8).tobytes())
                ids = [batch.column(k).slice(at, len(group)) for k in (0, 1)]
                at += len(group)
                numbers = [pa.array(x, pa.int64()) for x in (n, s1, s2)]
                lists = common.int_lists(toks, pa.int64(), np.int64)
                yield pa.RecordBatch.from_arrays([*ids, *numbers, lists, pa.array(sketch, pa.binary())], names=common.names_of(SURVEY))

    return run


def _sets(width: int):
    """Sets of texts, the last column; the other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, at = batch.num_columns - 1, 0
            for group in common.text_groups(batch.column(last)):
                sets = [shingle_set(t, width).tobytes() for t in group]
                kept = [c.slice(at, len(group)) for c in batch.columns[:last]]
                at += len(group)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary())], names=[*batch.schema.names[:last], "members"])

    return run


def _suffix(percent: int):
    """Pairs (a, b, na, nb and the counts per range of both) whose sets may still be similar: what ranges differ in, sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            most = total - 2 * -(-percent * total // (100 + percent))
            differ = np.empty(len(total), dtype=np.int64)
            for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), dtype=np.uint8).astype(np.int64), np.frombuffer(b.as_buffer(), dtype=np.uint8).astype(np.int64)
                ranges = min(len(x), len(y))
                differ[i] = np.abs(x.reshape(ranges, -1).sum(axis=1) - y.reshape(ranges, -1).sum(axis=1)).sum()
            keep = pa.array(differ <= most)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return run


COMPARED = "other long, centre long, n_other long, n_centre long, both long, diff array<long>"


def _compare(differences: bool):
    """Sizes and overlap of a centre's set with each of its others', from rows (centre, part, role, owner, members) of which
    a centre's own (role 0) comes first in each part. With differences what other has more or less than centre: what it has
    more comes first, then by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, y = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            ids, found, diff = [], [], []
            for centre, part, role, owner, members in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                x = np.frombuffer(members.as_buffer(), dtype=np.uint64)
                if not role:
                    place, y = (centre, part), x.copy()
                elif place == (centre, part):
                    both = np.intersect1d(x, y, assume_unique=True)
                    ids.append((owner, centre))
                    found.append((len(x), len(y), len(both)))
                    own = [np.setdiff1d(x, both, assume_unique=True), np.setdiff1d(y, both, assume_unique=True)] if differences else [x[:0]]
                    diff.append(common.signed(np.concatenate(own)))
            numbers = np.concatenate([np.array(a, dtype=np.int64).reshape(-1, n) for a, n in ((ids, 2), (found, 3))], axis=1)
            arrays = [*(pa.array(numbers[:, k].copy()) for k in range(5)), common.int_lists(diff, pa.int64(), np.int64)]
            yield pa.RecordBatch.from_arrays(arrays, names=common.names_of(COMPARED))

    return run


def salted(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """left joined with right, unique by `on`: rows of a key that many rows of left have are dealt by the column `by` to
    parts of PART rows, and right is copied once a part."""
    parts = left.groupBy(on).agg(F.expr(f"cast(ceil(count(*) / {PART}) as int)").alias("_parts")).filter("_parts > 1")
    copies = right.join(parts, on, "left").select("*", F.explode(F.expr("sequence(0, coalesce(_parts, 1) - 1)")).alias("_part"))
    dealt = left.join(parts, on, "left").withColumn("_part", F.expr(f"cast(coalesce(pmod(xxhash64({by}), _parts), 0) as int)"))
    return dealt.drop("_parts").join(copies.drop("_parts"), [on, "_part"]).drop("_part")


def _small(rows: DataFrame) -> DataFrame:
    """Materialized rows of a few numbers, without lists, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for the ends of links (a, b): least labels with pointer jumping."""
    edges = common.materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp"))
    labels = common.materialize(labels)
    while True:
        near = salted(edges, labels.select(F.col("node").alias("v"), "comp"), "v", "u").groupBy("u").agg(F.min("comp").alias("m"))
        new = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        new = common.materialize(new)
        jump = new.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = common.materialize(salted(new, jump, "comp", "node").select("node", "old", F.col("next").alias("comp")))
        labels = new.select("node", "comp")
        if not new.filter("comp <> old").limit(1).count():
            return labels


class Join:
    """The steps of the join over one table of texts."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT) -> None:
        self.width, self.percent = width, percent
        self.source = docs.select(common.order_id(key).alias("oid"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
        shared = docs.sparkSession.sparkContext.broadcast(slot_ranks(self.source, width))
        self.survey = common.materialize(common.map_batches(self.source, _survey(width, percent, shared), SURVEY))
        shared.unpersist()
        self.classes = common.materialize(self.survey.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("oid", "th")).alias("rep")))

    def _need(self, a: str, b: str) -> str:
        """The overlap that sets of sizes a and b need."""
        return f"(({self.percent} * ({a} + {b}) + {99 + self.percent}) div {100 + self.percent})"

    def _apart(self, a: str, b: str) -> str:
        """The most members that similar sets of sizes a and b may differ in."""
        return f"({a} + {b} - 2 * {self._need(a, b)})"

    def _near(self, a: str, b: str) -> str:
        """The length filter."""
        return f"{self.percent} * greatest({a}, {b}) <= 100 * least({a}, {b})"

    def lists(self) -> DataFrame:
        """The lists of prefix shingles in two sets or more: tok, owner, n (the set's size), pos (its place in the prefix)."""
        rows = self.survey.filter("size(toks) > 0").select(F.col("s1").alias("owner"), "n", F.posexplode("toks").alias("pos", "tok"))
        alive = rows.groupBy("tok").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least <> most").select("tok")
        alive = common.materialize(alive)
        return common.materialize(rows.join(alive, "tok").select("tok", "owner", "n", "pos").distinct())

    def stars(self, lists: DataFrame) -> DataFrame:
        """other, centre: the centre of each set that leads a third of its prefix. Others, which can hardly have much in common
        with their centres, do without one."""
        weight = lists.join(lists.groupBy("tok").agg(F.count("*").alias("m")), "tok").groupBy("owner").agg(F.sum("m").alias("weight"))
        weighed = common.materialize(lists.join(weight, "owner"))
        heads = weighed.groupBy("tok").agg(F.max(F.struct("weight", "owner", "n")).alias("head"))
        led = weighed.select("tok", "owner", "n").join(heads, "tok").groupBy("owner", "n", "head").agg(F.count("*").alias("c"))
        best = led.groupBy("owner", "n").agg(F.max(F.struct("c", "head")).alias("best"))
        best = best.select(F.col("owner").alias("other"), "n", F.col("best.c").alias("c"), F.col("best.head.owner").alias("centre"))
        prefix = f"n - ({self.percent} * n + 99) div 100 + 1"
        return common.materialize(best.filter(f"other <> centre and 3 * c >= {prefix}").select("other", "centre"))

    def compare(self, pairs: DataFrame, differences: bool = False) -> DataFrame:
        """COMPARED for pairs (other, centre). Every set in a pair is made again from the text of its class's representative,
        once, and sent from there: as other to its centres, as centre to each part of its others."""
        counts = pairs.groupBy("centre").agg(F.expr(f"cast(ceil(count(*) / {PART}) as int)").alias("parts"))
        part = F.expr("cast(pmod(xxhash64(other), parts) as int)").alias("part")
        as_other = pairs.join(counts, "centre").select(F.col("other").alias("owner"), F.struct("centre", part, F.lit(1).alias("role")).alias("to"))
        parts = counts.select("centre", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
        as_centre = parts.select(F.col("centre").alias("owner"), F.struct("centre", "part", F.lit(0).alias("role")).alias("to"))
        ways = common.materialize(as_other.union(as_centre))
        places = self.classes.select(F.col("s1").alias("owner"), F.col("rep.oid").alias("oid"), F.col("rep.th").alias("th"))
        wanted = common.materialize(places.join(ways.select("owner").distinct(), "owner"))
        texts = self.source.join(_small(wanted), ["oid", "th"]).select("owner", "text")
        sets = common.map_batches(texts, _sets(self.width), "owner long, members binary")
        sent = sets.join(_small(ways), "owner").select("to.*", "owner", "members")
        met = sent.repartition("centre", "part").sortWithinPartitions("centre", "part", "role")
        compared = common.map_batches(met, _compare(differences), COMPARED)
        return common.materialize(compared.dropDuplicates(["other", "centre"]))

    def similar(self) -> str:
        """Whether a row of COMPARED is a link."""
        return f"100 * both >= {self.percent} * (n_other + n_centre - both)"

    def screen(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the suffix filter."""
        sketches = self.survey.filter("length(sketch) > 0").select(F.col("s1").alias("owner"), "n", "sketch")
        sketches = sketches.dropDuplicates(["owner"])
        first = sketches.withColumnsRenamed({"owner": "a", "n": "na", "sketch": "sa"})
        second = sketches.withColumnsRenamed({"owner": "b", "n": "nb", "sketch": "sb"})
        rows = pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "sa", "sb")
        return common.materialize(common.map_batches(rows, _suffix(self.percent), "a long, b long"))

    def found(self, every: bool = False) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) between classes, named by s1, enough to connect every component; and differences (owner, cloud, n, d).

        With every these are all links but those of two sets of one cloud (centre) whose differences are small enough
        together, which `degrees` counts from the second table.
        """
        lists = self.lists()
        stars = self.compare(self.stars(lists), differences=True)
        first = stars.filter(self.similar()).select(F.col("other").alias("a"), F.col("centre").alias("b"))
        clouds = stars.filter("2 * (n_other + n_centre - 2 * both) <= n_other + n_centre")
        clouds = clouds.select(
            F.col("other").alias("owner"), F.col("centre").alias("cloud"), F.col("n_other").alias("n"),
            (F.col("n_other") + F.col("n_centre") - 2 * F.col("both")).alias("d"), F.expr(f"if({self.similar()}, centre, other)").alias("comp"),
            "diff"
        )
        clouds = common.materialize(clouds)

        # Pairs of one cloud: found by the prefixes of their differences, verified on these.
        apart = self._apart("na", "nb")
        prefix = f"d - greatest(1, d - (100 - {self.percent}) * n div {self.percent}) + 1"
        rows = clouds.select("owner", "cloud", "n", "d", "comp", F.posexplode(F.expr(f"slice(diff, 1, cast({prefix} as int))")).alias("pos", "tok"))
        shared = rows.groupBy("cloud", "tok").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least <> most")
        rows = common.materialize(rows.join(shared.select("cloud", "tok"), ["cloud", "tok"]))
        side = lambda k: [F.col(c).alias(f"{c[0] if c != "owner" else ""}{k}") for c in ("owner", "n", "d", "pos", "comp")]
        may = f"{self._near('na', 'nb')} and da + db > {apart} and 2 * least(da - pa, db - pb) >= da + db - {apart}"
        inside = rows.select("cloud", "tok", *side("a")).join(rows.select("cloud", "tok", *side("b")), ["cloud", "tok"])
        inside = inside.filter(F.expr(f"a < b and {'true' if every else 'ca <> cb'} and {may}")).select("a", "b").distinct()
        whole = clouds.select("owner", "n", "diff")
        inside = inside.join(
            whole.withColumnsRenamed({"owner": "a", "n": "na", "diff": "xa"}), "a"
        ).join(whole.withColumnsRenamed({"owner": "b", "n": "nb", "diff": "xb"}), "b")
        inside = inside.filter(F.expr(f"size(xa) + size(xb) - 2 * size(array_intersect(xa, xb)) <= {apart}")).select("a", "b")

        # Pairs of different clouds: by their own prefixes.
        rows = lists.join(clouds.select("owner", "cloud", "comp"), "owner", "left").withColumns({
            "cloud": F.coalesce("cloud", "owner"), "comp": F.coalesce("comp", "owner")
        })
        side = lambda k: [
            F.col(c).alias(f"{c[0] if c != "owner" else ""}{k}") for c in ("owner", "n", "pos", "comp")
        ] + [F.col("cloud").alias(f"cloud_{k}")]
        may = f"{self._near('na', 'nb')} and 1 + least(na - pa - 1, nb - pb - 1) >= {self._need('na', 'nb')}"
        across = rows.select("tok", *side("a")).join(rows.select("tok", *side("b")), "tok")
        across = across.filter(F.expr(f"a < b and cloud_a <> cloud_b and {'true' if every else 'ca <> cb'} and {may}")).select("a", "b").distinct()

        pairs = self.screen(common.materialize(across)).select(F.col("a").alias("other"), F.col("b").alias("centre"))
        second = self.compare(pairs).filter(self.similar()).select(F.col("other").alias("a"), F.col("centre").alias("b"))
        links = first.union(inside).union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return common.materialize(links), clouds.select("owner", "cloud", "n", "d")

    def degrees(self, links: DataFrame, clouds: DataFrame) -> DataFrame:
        """s1, s2 and n_links of every class: the other rows that a row of it is linked with, equal ones among them."""
        sizes = common.materialize(self.survey.filter("n > 0").groupBy("s1", "s2").agg(F.count("*").alias("rows")))
        ends = links.select("a", "b").union(links.select("b", "a"))
        near = ends.join(sizes.select(F.col("s1").alias("b"), "rows"), "b").groupBy(F.col("a").alias("s1")).agg(F.sum("rows").alias("near"))
        # Pairs of one cloud whose differences are small enough together: counted by size and difference, not made.
        own = common.materialize(clouds.join(sizes.select(F.col("s1").alias("owner"), "rows"), "owner"))
        cells = common.materialize(own.groupBy("cloud", "n", "d").agg(F.sum("rows").alias("rows")))
        apart = self._apart("n", "nb")
        pairs = cells.select("cloud", "n", "d").join(
            cells.withColumnsRenamed({"n": "nb", "d": "db", "rows": "rb"}), "cloud"
        ).filter(F.expr(f"d + db <= {apart}"))
        sums = pairs.groupBy("cloud", "n", "d").agg(F.sum("rb").alias("sure"))
        self_link = F.expr(f"if(2 * d <= {self._apart('n', 'n')}, rows, 0)")
        sure = own.join(sums, ["cloud", "n", "d"]).select(F.col("owner").alias("s1"), (F.col("sure") - self_link).alias("sure"))
        total = F.col("rows") - 1 + F.coalesce("near", F.lit(0)) + F.coalesce("sure", F.lit(0))
        return sizes.join(near, "s1", "left").join(sure, "s1", "left").select("s1", "s2", total.alias("n_links"))

    def members(self, counted: bool = False) -> DataFrame:
        """A row per row of the texts: oid, th, n and component (the smallest oid of it; its own for an empty set); counted adds n_links."""
        links, clouds = self.found(every=counted)
        labels = components(links)
        of = self.classes.join(labels.withColumnRenamed("node", "s1"), "s1", "left").select(
            "s1", "s2", F.col("rep.oid").alias("oid"), F.coalesce("comp", "s1").alias("comp")
        )
        of = common.materialize(of)
        of = salted(of, of.groupBy("comp").agg(F.min("oid").alias("component")), "comp", "s1").select("s1", "s2", "component")
        of = common.materialize(of.join(self.degrees(links, clouds), ["s1", "s2"]) if counted else of)
        more = ["n_links"] if counted else []
        rows = self.survey.filter("n > 0").select("oid", "th", "n", "s1", "s2").join(of, ["s1", "s2"]).select("oid", "th", "n", "component", *more)
        empty = self.survey.filter("n = 0").select("oid", "th", "n", F.col("oid").alias("component"), *(F.lit(0).cast("long").alias(c) for c in more))
        return rows.unionByName(empty)


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest id (of equal ids, the smallest text hash; of
    rows equal in id and text, that of the least hash of all columns). Rows without words are all kept, equal ones once."""
    members = Join(docs, text, key, width, percent).members()
    kept = members.filter("n > 0").groupBy("component").agg(F.min(F.struct("oid", "th")).alias("k")).select("k.oid", "k.th")
    kept = kept.union(members.filter("n = 0").select("oid", "th").distinct())
    oid, th, many = common.free_names(docs, "_oid", "_th", "_many")
    kept = kept.join(members.groupBy("oid", "th").agg((F.count("*") > 1).alias(many)), ["oid", "th"]).withColumnsRenamed({"oid": oid, "th": th})
    kept = common.materialize(kept)
    few = kept.count() <= BROADCAST_ROWS
    rows = docs.withColumns({oid: common.order_id(key), th: F.xxhash64(F.col(text))}).join(F.broadcast(kept) if few else kept, [oid, th])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.filter(~F.col(many)).select(*columns)
    if not kept.filter(many).limit(1).count():
        return once
    first = rows.filter(many).groupBy(oid, th).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(many))
    return once.unionByName(first.select(f"{many}.*"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set, its component and its number of links."""
    members = Join(common.table(spark, sf_dir, "documents").select("doc_id", "text")).members(counted=True)
    ids = {"doc_id": "oid", "component_id": "component"}
    return members.select(F.col("n").alias("n_shingles"), "n_links", *(F.nullif(F.col(c), F.lit(2**63 - 1)).alias(name) for name, c in ids.items()))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
     r AS (SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS BIGINT) AS component_id,
       CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a) AS k USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS least_id FROM r GROUP BY node) AS m USING (doc_id)
"""
