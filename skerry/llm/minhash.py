"""Document fingerprints by Order MinHash, with DataFrame functions only.

A k-mer is K consecutive pieces of a text; pieces are words, cut into parts of PIECE characters, and the k-mers at the
end are shorter. Repeated k-mers are numbered by occurrence, and k-mer and number are hashed together. The hash
deals them to BUCKETS buckets; in each the TUPLE least are selected, put back into text order, and their tuple is
hashed. A bucket agrees only where the same k-mers stand in the same order, so moved passages lower the likeness.
Likeness of two fingerprints: buckets that agree, as a share of those that either text fills; two texts without pieces
are alike (1).

Occurrence numbers come from run lengths in the sorted hashes, found by doubling: c(k+1)[j] = c(k)[j] + c(k)[j - 2^k]
where c(k)[j] has reached 2^k. Work is n log n in the length of a text, and nothing is exploded. Text order is that of
positions. A position has BITS bits: in a text of more than 2^BITS pieces it is counted in units of two pieces, or four, and
so on, so that the last one fits; k-mers that start within one unit then stand in the order of their hashes.

The next document is that of the next smaller id; after the last comes the first. Rows equal in id and text are one
document; among equal ids texts are ordered by their hash; null ids come before all others; null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, PIECE, BUCKETS, TUPLE = 3, 12, 32, 2
BITS = 24
"""Of a sort key the low bits hold the position, the others the hash."""


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column out: an array of BUCKETS hashes, null where no k-mer fell."""
    low, bits = (1 << BITS) - 1, BUCKETS.bit_length() - 1
    high, rest = ~low, 63 - BITS
    w, u, s, r, o, e, x = (f"_{out}_{c}" for c in ("w", "u", "s", "r", "o", "e", "x"))
    more = ", ".join(f"get({w}, i + {j})" for j in range(1, K))
    df = df.withColumn(w, F.expr(rf"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]{{1,{PIECE}}}', 0)"))
    df = df.withColumn(u, F.expr(f"greatest(length(bin(greatest(size({w}) - 1, 0))) - {BITS}, 0)"))  # a unit has 2^u pieces
    df = df.withColumn(s, F.expr(f"sort_array(transform({w}, (g, i) -> (xxhash64(g, {more}) & {high}L) | shiftright(i, {u})))"))
    same = lambda a, at: f"coalesce(shiftright(get({a}, {at}), {BITS}) = shiftright(v, {BITS}), false)"
    df = df.withColumn(r, F.expr(f"filter({s}, (v, j) -> {same(s, 'j - 1')} or {same(s, 'j + 1')})"))
    ones = f"transform({r}, (v, j) -> if({same(r, 'j - 1')}, 1, 0))"
    step = "transform(c, (n, j) -> if(n = shiftleft(1, k), n + get(c, j - shiftleft(1, k)), n))"
    df = df.withColumn(o, F.expr(f"if(size({r}) = 0, array(), aggregate(sequence(0, 30), {ones}, (c, k) -> if(array_max(c) < shiftleft(1, k), c, {step})))"))
    hashed = lambda v, n: f"(xxhash64(shiftright({v}, {BITS}), {n}) & {high}L) | ({v} & {low})"
    once = f"transform(filter({s}, (v, j) -> not ({same(s, 'j - 1')} or {same(s, 'j + 1')})), v -> {hashed('v', 0)})"
    again = f"transform(arrays_zip({r}, {o}), z -> {hashed(f'z.{r}', f'z.{o}')})"
    df = df.withColumn(e, F.expr(f"sort_array(concat({once}, {again}))"))
    bucket = lambda v: f"shiftrightunsigned({v}, {64 - bits})"
    df = df.withColumn(x, F.expr(f"filter({e}, (v, j) -> not coalesce({bucket(f'get({e}, j - {TUPLE})')} = {bucket('v')}, false))"))
    turned = f"transform(filter({x}, v -> {bucket('v')} = b), v -> shiftleft(v & {low}, {rest}) | shiftrightunsigned(v, {BITS + 1}))"
    in_order = f"transform(sort_array({turned}), v -> v & {(1 << rest) - 1}L)"
    df = df.withColumn(out, F.expr(f"transform(sequence(0, {BUCKETS - 1}), b -> if(exists({x}, v -> {bucket('v')} = b), xxhash64({in_order}), null))"))
    return df.drop(w, u, s, r, o, e, x)


def likeness(a: str, b: str) -> F.Column:
    alike = f"size(filter(sequence(0, {BUCKETS - 1}), i -> get({a}, i) = get({b}, i)))"
    filled = f"size(filter(sequence(0, {BUCKETS - 1}), i -> get({a}, i) is not null or get({b}, i) is not null))"
    return F.expr(f"coalesce(cast({alike} as double) / nullif({filled}, 0), 1.0e0)")


def written(column: str) -> F.Column:
    """A fingerprint as text: eight hexadecimal digits a bucket, dashes for an empty one."""
    return F.expr(f"array_join(transform({column}, v -> coalesce(lpad(lower(hex(v & 4294967295L)), 8, '0'), '--------')), '')")


def neighbours(ids: DataFrame) -> DataFrame:
    """oid, th, n, m of each document, with next_oid and next_th of the one after it; ids holds a row per row (oid, th, n).

    Ids are dealt to ranges; each range is ordered by itself, and only the first of every range meet in one task.
    """
    units = ids.groupBy("oid", "th").agg(F.first("n").alias("n"), F.count("*").alias("m"))
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.materialize(units.repartitionByRange(parts, F.desc("oid"), F.asc("th")).withColumn("part", F.spark_partition_id()))
    order = [F.desc("oid"), F.asc("th")]
    heads = dealt.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(*order))).filter("r = 1").select("part", "oid", "th")
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    heads = heads.withColumn("a", F.struct("oid", "th")).withColumn(
        "b", F.coalesce(F.lead("a").over(line), F.first("a").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ).select("part", "b")
    own = dealt.withColumn("a", F.lead(F.struct("oid", "th")).over(Window.partitionBy("part").orderBy(*order)))
    own = own.join(F.broadcast(heads), "part").withColumn("a", F.coalesce("a", "b"))  # a row a partition
    return own.select("oid", "th", "n", "m", F.col("a.oid").alias("next_oid"), F.col("a.th").alias("next_th"))


def compare(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: oid, text, edited (text), own, edited_own and next_own (fingerprints)."""
    source = docs.select(common.order_id(key).alias("oid"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    base = fingerprint(source.select("oid", "th", "text"), "text", "own")
    near = common.materialize(neighbours(source.select("oid", "th", F.char_length("text").alias("n"))))
    give = near.select(
        F.col("next_oid").alias("oid"), F.col("next_th").alias("th"), F.col("oid").alias("to_oid"), F.col("th").alias("to_th"),
        F.expr("n div 3").cast("int").alias("need")
    )
    give = give.join(near.select("oid", "th", "m"), ["oid", "th"])
    given = base.join(give, ["oid", "th"]).select("to_oid", "to_th", "m", F.expr("left(text, need)").alias("tail"), F.col("own").alias("next_own"))
    once = given.filter("m = 1").drop("m")
    copies = given.filter("m > 1").drop("m").dropDuplicates(["to_oid", "to_th"])
    given = once.unionByName(copies)
    rows = base.join(given, (F.col("oid") == F.col("to_oid")) & (F.col("th") == F.col("to_th")))
    rows = rows.withColumn("edited", F.expr("concat(left(text, char_length(text) - char_length(text) div 3), tail)"))
    return fingerprint(rows.select("oid", "text", "edited", "own", "next_own"), "edited", "edited_own")


def op8(spark, sf_dir: str) -> DataFrame:
    rows = compare(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.nullif(F.col("oid"), F.lit(2**63 - 1)).alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written("own").alias("fingerprint"),
        written("edited_own").alias("edited_fingerprint"), likeness("own", "edited_own").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )
