"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target: its share, by weight, of a total budget, but at most ``most_epochs`` times its own size; what the cap
cuts off is shared again by weight among the others. The documents of a source are shuffled by a hash of their ids and queue
once for each epoch; an entry's virtual finish time is the source's cumulative tokens, over all epochs so far, divided by its
target. Entries are then ordered by finish time over all sources and cut at the total of the targets, so every source is
served up to a finish time of about 1, its target.

The rows are never sorted in one task. The cumulative sums are made in ranges of the shuffle key within each source, and of the
finish time over all sources: sums for each range, a running sum over the ranges, and a running sum inside each range. The number of
ranges follows the number of rows, so a source or a time range of any size is spread evenly. Only the tables of the sources and of the
ranges' sums (a row for RANGE_ROWS rows) are summed in one task each. Rows of one id share a shuffle key and so a range.

Defined cases: a null text has size 0; sources are ordered by code point with null last and weighted by that order; documents
of size 0 are taken 0 words; repeated rows queue one after the other and get a row each; a null id shuffles as an id of its own;
very long texts count whole; other columns do not matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

#: Rows that one range holds, about.
RANGE_ROWS = 4_000
ENTRY = ("doc_id", "source", "text_hash", "size", "nth")


def targets(sources: DataFrame, weights: list[float], budget: float, most_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    With sources in ascending order of cap over weight, those whose cap lies below the level that the rest would reach get
    their cap; the first that does not fixes the level of all that follow.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sources.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")).alias("w"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(float(budget)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    rows = rows.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(Window.partitionBy())
    rows = rows.withColumn("free", free)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("free.level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, nth (which of several equal rows), size, source, source_size,
    target, epochs, taken."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    sizes = durable(sizes.withColumn("key", key))
    by_source = durable(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), budget, most_epochs))
    count = sizes.count()
    ranges = max(1, -(-count // RANGE_ROWS))

    # Running sums within each source, in the order of the shuffle key.
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")
    rows = sizes.withColumn("at", at)
    upto = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "at").agg(F.sum("size").alias("n")).select(F.col("source").alias("of"), F.col("at").alias("from"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("from"))).drop("of", "from")
    inside = Window.partitionBy("source", "at").orderBy("key", "doc_id", "size", "text_hash")
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(by_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.select("doc_id", "text_hash", "key", "nth", "source", "size", "source_size", "target", "upto")

    # Finish times over all sources, ranges of them, and the cut.
    budget_words = F.sum("target").over(Window.partitionBy())
    total = by_source.select("target").withColumn("all", budget_words).select(F.max("all").alias("all"))
    entries = rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most_epochs - 1))))
    entries = entries.withColumn("finish", (F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("target"))
    slot = F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)).cast("int")
    entries = durable(entries.select("doc_id", "text_hash", "key", "nth", "source", "size", "epoch", "finish", slot.alias("slot")))
    ordered = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = entries.groupBy("slot").agg(F.sum("size").alias("n")).select("slot", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("start"))
    starts = durable(starts.join(total, F.lit(True)).where("start < all"))  # one row of totals
    last = starts.agg(F.max("slot")).head()[0]  # starts grow with the slots, so later slots lie wholly beyond the cut
    entries = entries.where(F.col("slot") <= F.lit(last))
    within = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "size", "text_hash", "nth", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    served = entries.join(starts, "slot").withColumn("sent", F.col("start") + F.sum("size").over(within)).where("sent <= all")
    taken = served.groupBy(*ENTRY).agg(F.count("*").cast("int").alias("epochs"))
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in ENTRY], "epochs")
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in ENTRY])
    n = F.coalesce("epochs", F.lit(0))
    return rows.join(taken, match, "left").select("doc_id", "text_hash", "nth", "size", "source", "source_size", "target", n.alias("epochs"), (F.col("size") * n).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as it is taken; all columns are kept."""
    found = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    found = found.select(F.col("doc_id").alias("taken_id"), F.col("text_hash").alias("taken_hash"), F.col("source").alias("taken_source"), F.struct("nth", "epochs").alias("e"))
    found = found.groupBy("taken_id", "taken_hash", "taken_source").agg(F.sort_array(F.collect_list("e")).alias("each")).where("exists(each, x -> x.epochs > 0)")
    names = docs.columns
    wide = docs.toDF(*[f"c{i}" for i in range(len(names))])
    col = lambda c: F.col(f"c{names.index(c)}")
    wide = wide.withColumns({"own_id": col(id_col).cast("long"), "own_hash": F.xxhash64(col(text_col)), "own_source": col(source_col).cast("string")})
    same = [F.col(f"own_{c}").eqNullSafe(F.col(f"taken_{c}")) for c in ("id", "hash", "source")]
    nth = F.row_number().over(Window.partitionBy("own_id", "own_hash", "own_source").orderBy("own_id"))  # equal rows are interchangeable
    out = wide.join(found, same[0] & same[1] & same[2]).withColumn("own_nth", nth).withColumn("copies", F.get("each.epochs", F.col("own_nth") - 1))
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'none')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * w, cap)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, source, size, key, epoch, (upto + epoch * source_size)::DOUBLE / target AS finish FROM r, (VALUES (0), (1)) v(epoch) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS sent FROM e),
k AS (SELECT doc_id, count(*) AS epochs FROM c WHERE sent <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT r.doc_id, r.size::BIGINT AS size, r.source_size, r.target, (r.size * coalesce(k.epochs, 0))::BIGINT AS taken FROM r LEFT JOIN k ON r.doc_id = k.doc_id
"""
