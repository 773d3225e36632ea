"""Doubt about chimeric contigs: whether other alignments of a contig explain it as well as those that make up its chimera.

Chains from one end of a contig to the other are never enumerated, as their number may be exponential. What is kept is the best chain that reaches each
segment: contigs of few segments do so in a row each, those of more in a table, where a step joins it with the edges and keeps one row for each segment.
Edges lead to later starts, so this ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import is_alternative
from ..lineage import cut
from .segments import _follows, edges

NODE = ["query", "seg_id", "query_len", "target", "qstart", "qend", "tstart", "edits"]


def _nodes(segments: DataFrame, from_edge: float) -> DataFrame:
    edge = F.greatest(F.lit(1), F.floor(F.col("query_len") * from_edge))
    edits = F.coalesce(F.col("edits"), F.lit(0)).cast("bigint")
    return segments.select("query", "seg_id", "qstart", "qend", edits.alias("edits"), (F.col("qstart") <= edge).alias("starts"), (F.col("qend") >= F.col("query_len") - edge + 1).alias("ends"))


def end_to_end(segments: DataFrame, from_edge: float = 0.02, in_row: int = 40) -> DataFrame:
    """(query, covered, edits): of each contig that segments chain from end to end, the chain that covers most of it and, of those, has
    the fewest edits. ``query`` may be of any type. Edges leave no overlap but between neighbours, so what a chain covers is a sum.

    Contigs of up to ``in_row`` segments are worked out in a row each, in one shuffle; those of more by rounds of joins, and of these no row is made."""
    nodes = _nodes(segments, from_edge).where(F.col("query").isNotNull())
    nth = F.row_number().over(Window.partitionBy("query").orderBy("qstart", "qend", "seg_id"))
    node = F.when(F.col("_nth") <= in_row, F.struct("qstart", "qend", "seg_id", "edits", "starts", "ends"))
    rows = nodes.withColumn("_nth", nth).groupBy("query").agg(F.sort_array(F.collect_list(node)).alias("_all"), (F.max("_nth") > in_row).alias("_many"))
    done = rows.select("query", "_many", F.when(~F.col("_many"), _best_in_row(F.col("_all"))).alias("v"))
    done = cut(done.where("_many or v is not null"))
    found = done.where("not _many").select("query", F.col("v.covered").alias("covered"), (-F.col("v.less")).alias("edits"))
    many = done.where("_many").select("query")
    return found if many.isEmpty() else found.union(_best_in_rounds(nodes.join(many, "query", "left_semi")))


def _best_in_row(nodes: Column) -> Column:
    """(covered, less) of the best chain of a contig's segments, in the order of their starts; null where none is from end to end. Each segment takes
    the best chain that it can follow, as the rest of a chain adds the same to all that reach a segment."""
    value = "struct<covered: bigint, less: bigint>"
    kind = f"array<struct<qstart: bigint, qend: bigint, ends: boolean, best: {value}>>"
    pair = lambda covered, less: F.struct(covered.cast("bigint").alias("covered"), less.cast("bigint").alias("less"))

    def add(found: Column, x: Column) -> Column:
        own = x["qend"] - x["qstart"] + 1

        def grown(y: Column) -> Column:
            follows, over, _ = _follows(y["qstart"], y["qend"], x["qstart"], x["qend"])
            return F.when(follows, pair(y["best"]["covered"] + own - over, y["best"]["less"] - x["edits"]))

        ways = F.concat(F.transform(found, grown), F.array(F.when(x["starts"], pair(own, -x["edits"]))))
        node = lambda best: F.struct(x["qstart"].cast("bigint").alias("qstart"), x["qend"].cast("bigint").alias("qend"), x["ends"].alias("ends"), best.alias("best"))
        return F.concat(found, F.filter(F.transform(F.array(F.array_max(ways)), node), lambda n: n["best"].isNotNull()))

    found = F.aggregate(nodes, F.array().cast(kind), add)
    return F.array_max(F.transform(F.filter(found, lambda n: n["ends"]), lambda n: n["best"]))


def _best_in_rounds(nodes: DataFrame) -> DataFrame:
    """The same for contigs of any number of segments."""
    rows = cut(nodes)
    links = cut(edges(rows).select("query", "i", "j", "overlap"))
    value = F.struct(F.col("covered"), (-F.col("edits")).alias("less"))
    step = rows.where("starts").select("query", "seg_id", (F.col("qend") - F.col("qstart") + 1).alias("covered"), "edits", "ends")
    to = rows.select("query", F.col("seg_id").alias("j"), (F.col("qend") - F.col("qstart") + 1).alias("own"), F.col("edits").alias("more"), F.col("ends").alias("to_end"))
    done = step.where("ends")
    while True:
        grown = step.select("query", F.col("seg_id").alias("i"), "covered", "edits").join(links, ["query", "i"]).join(to, ["query", "j"])
        grown = grown.select("query", F.col("j").alias("seg_id"), (F.col("covered") + F.col("own") - F.col("overlap")).alias("covered"), (F.col("edits") + F.col("more")).alias("edits"), F.col("to_end").alias("ends"))
        best = grown.groupBy("query", "seg_id").agg(F.max(value).alias("v"), F.first("ends").alias("ends"))
        step = cut(best.select("query", "seg_id", F.col("v.covered").alias("covered"), (-F.col("v.less")).alias("edits"), "ends"))
        if step.isEmpty():
            break
        done = done.union(step.where("ends"))
    best = done.groupBy("query").agg(F.max(value).alias("v"))
    return best.select("query", F.col("v.covered").alias("covered"), (-F.col("v.less")).alias("edits"))


def canonical(segments: DataFrame) -> DataFrame:
    return segments.where(~F.coalesce(is_alternative(F.col("target")), F.lit(False)))


def replaceable(members: DataFrame, others: DataFrame, from_edge: float = 0.02) -> DataFrame:
    """(query, seg_id) of the members of chimeras that are in doubt: without that one, the other members and ``others``, alignments of the
    same contigs that are no members, still chain the contig from end to end."""
    mine = members.select(*NODE)
    pool = mine.union(others.select(*NODE).join(mine.select("query", "seg_id"), ["query", "seg_id"], "left_anti").select(*NODE))
    pool = pool.join(mine.select("query", F.col("seg_id").alias("out")), "query").where("seg_id <> out")
    pool = pool.withColumn("query", F.struct("query", "out"))
    return end_to_end(pool, from_edge).select("query.query", F.col("query.out").alias("seg_id"))


def outdone(members: DataFrame, others: DataFrame, from_edge: float = 0.02) -> DataFrame:
    """(query) of the chimeras that ``others`` alone chain at least as well: covering more of the contig, or as much with no more edits in all."""
    end = F.max("qend").over(Window.partitionBy("query").orderBy("qstart", "qend", "seg_id").rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.col("qend") - F.greatest(F.col("qstart"), F.coalesce(F.col("_end") + 1, F.col("qstart"))) + 1, F.lit(0))
    mine = members.withColumn("_end", end).groupBy("query").agg(F.sum(own).alias("_covered"), F.sum(F.coalesce("edits", F.lit(0))).alias("_edits"))
    rest = others.join(members.select("query", "seg_id"), ["query", "seg_id"], "left_anti").join(members.select("query").distinct(), "query", "left_semi")
    best = end_to_end(rest.select(*NODE), from_edge)
    return best.join(mine, "query").where((F.col("covered") > F.col("_covered")) | ((F.col("covered") == F.col("_covered")) & (F.col("edits") <= F.col("_edits")))).select("query")


def same_target(members: DataFrame, others: DataFrame, most_span: int = 1_000_000, from_edge: float = 0.02) -> DataFrame:
    """(query, seg1, seg2, span): two alignments to one target that replace a chimera over several. Of each member in turn, in the order of
    seg_id, the pairs among itself and ``others`` on its target count that chain the contig and start less than ``most_span`` apart; the
    first member that has any gives the closest of its pairs, ties by ids."""
    several = members.groupBy("query").agg(F.countDistinct("target").alias("n")).where("n > 1").select("query")
    mine = members.select(*NODE).join(several, "query", "left_semi")
    near = others.select(*NODE).join(mine.select("query", F.col("seg_id").alias("of"), F.col("target").alias("_target")), "query").where("target = _target and seg_id <> of").drop("_target")
    pool = cut(mine.withColumn("of", F.col("seg_id")).select(*NODE, "of").union(near.select(*NODE, "of")).withColumn("query", F.struct("query", "of")))
    nodes = _nodes(pool, from_edge).join(pool.select("query", "seg_id", "tstart"), ["query", "seg_id"])
    side = lambda n: nodes.select("query", F.col("seg_id").alias("ij"[n - 1]), F.col("tstart").alias(f"t{n}"), F.col("starts" if n == 1 else "ends").alias(f"e{n}"))
    pairs = edges(pool).select("query", "i", "j").join(side(1), ["query", "i"]).join(side(2), ["query", "j"]).where("e1 and e2").withColumn("span", F.abs(F.col("t1") - F.col("t2")))
    best = pairs.where(F.col("span") < most_span).groupBy("query.query").agg(F.min(F.struct("query.of", "span", "i", "j")).alias("b"))
    return best.select("query", F.col("b.i").alias("seg1"), F.col("b.j").alias("seg2"), F.col("b.span").alias("span"))


def swapped(members: DataFrame, others: DataFrame, swaps: DataFrame) -> DataFrame:
    """Members of all chimeras, with those of ``swaps`` (see ``same_target``) in place of what they replace."""
    pick = swaps.select("query", F.explode(F.array("seg1", "seg2")).alias("seg_id"))
    every = members.unionByName(others).dropDuplicates(["query", "seg_id"])
    return members.join(swaps.select("query"), "query", "left_anti").unionByName(every.join(pick, ["query", "seg_id"], "left_semi"))
