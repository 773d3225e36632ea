"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bridge import ctes, spark_view
from .functions import cigar as C
from .functions import coords, transcripts
from .functions import sequences as Q
from .operators import adjacency as A
from .operators import chimeras as X
from .operators import exons as E
from .operators import fusion as U
from .operators import intervals as I
from .operators import rescue as H
from .operators import segments as S
from .operators import splice as P
from .operators import support as R
from .operators import variants as V
from .sinks import tables as T
from .sinks import vcf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Shared pieces of SQL.
_PAIRS = (
    ctes("segments")
    + """,
p0 AS (SELECT query, seg_id AS seg1, lead(seg_id) OVER w AS seg2, target AS t1, strand AS strand1, tstart AS ts1, tend AS te1, qend AS cb1, lead(target) OVER w AS t2, lead(strand) OVER w AS strand2,
         lead(tstart) OVER w AS ts2, lead(tend) OVER w AS te2, lead(qstart) OVER w AS cb2 FROM segments WINDOW w AS (PARTITION BY query ORDER BY qstart, qend, seg_id)),
p1 AS (SELECT *, CASE WHEN strand1 = '+' THEN te1 ELSE ts1 END AS xp, CASE WHEN strand1 = '+' THEN 'L' ELSE 'R' END AS xo, CASE WHEN strand2 = '+' THEN ts2 ELSE te2 END AS yp,
         CASE WHEN strand2 = '+' THEN 'R' ELSE 'L' END AS yo FROM p0 WHERE seg2 IS NOT NULL),
p2 AS (SELECT *, t2 < t1 OR (t2 = t1 AND yp < xp) AS swapped FROM p1),
p3 AS (SELECT *, CASE WHEN swapped THEN t2 ELSE t1 END AS chrom1, CASE WHEN swapped THEN yp ELSE xp END AS b0, CASE WHEN swapped THEN yo ELSE xo END AS orient1,
         CASE WHEN swapped THEN t1 ELSE t2 END AS chrom2, CASE WHEN swapped THEN xp ELSE yp END AS b1, CASE WHEN swapped THEN xo ELSE yo END AS orient2 FROM p2),
p4 AS (SELECT *, chrom1 = chrom2 AND orient1 = 'L' AND orient2 = 'R' AND b1 - b0 IN (0, 1) AND cb1 >= cb2 AS moved,
         CASE WHEN chrom1 <> chrom2 THEN 'trl' WHEN orient1 = orient2 THEN 'inv' WHEN orient1 = 'L' AND b1 - b0 IN (0, 1) THEN CASE WHEN cb1 >= cb2 THEN 'del' ELSE 'ins' END
              WHEN orient1 = 'L' THEN CASE WHEN b0 < b1 THEN 'del' ELSE 'dup' END WHEN b0 = b1 THEN 'ins' ELSE 'dup' END AS rearrangement FROM p3),
classified AS (SELECT query, seg1, seg2, rearrangement, chrom1, CASE WHEN moved THEN b1 + 1 ELSE b0 END AS break1, orient1, chrom2, CASE WHEN moved THEN b0 + cb1 - cb2 + 1 ELSE b1 END AS break2, orient2,
         cb1, cb2, swapped, strand1, strand2, CASE WHEN cb1 >= cb2 AND NOT moved THEN cb2 END AS homol1, CASE WHEN cb1 >= cb2 AND NOT moved THEN cb1 END AS homol2 FROM p4),
merged AS (SELECT row_number() OVER (ORDER BY rearrangement, chrom1, break1, orient1, chrom2, break2, orient2) AS adj_id, rearrangement, chrom1, break1, orient1, chrom2, break2, orient2,
         string_agg(query || ':' || cb1 || '-' || cb2, ',' ORDER BY seg1) AS members, count(*) AS n_contigs FROM classified GROUP BY rearrangement, chrom1, break1, orient1, chrom2, break2, orient2)"""
)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "segments")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return S.classify(S.consecutive(_segments(spark, d).select("seg_id", "query", "target", "strand", "qstart", "qend", "tstart", "tend")))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return A.merge(_classified(spark, d).withColumn("seq_no", F.col("seg1")))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Ids and places of ``_merged`` alone."""
    return A.places(_classified(spark, d))


@query(_PAIRS + "SELECT * FROM classified")
def classify_split_pairs(spark, d):
    return _classified(spark, d)


@query(_PAIRS + "SELECT * FROM merged")
def merge_adjacencies(spark, d):
    text = F.array_join(F.transform("members", lambda m: F.concat(m["contig"], F.lit(":"), m["cb1"], F.lit("-"), m["cb2"])), ",")
    return _merged(spark, d).withColumn("members", text)


@query(
    _PAIRS
    + ctes("sequences").replace("WITH ", ", ")
    + """SELECT seg1, rearrangement, CASE WHEN homol1 IS NOT NULL THEN substr(seq, homol1, homol2 - homol1 + 1) END AS homol_seq,
    CASE WHEN cb2 - cb1 > 1 THEN CASE WHEN strand1 = '-' THEN translate(reverse(substr(seq, cb1 + 1, cb2 - cb1 - 1)), 'agtcAGTC', 'tcagTCAG') ELSE substr(seq, cb1 + 1, cb2 - cb1 - 1) END END AS novel_seq
    FROM classified JOIN sequences ON query = name"""
)
def microhomology_untemplated(spark, d):
    return S.junction_sequences(_classified(spark, d), spark_view(spark, d, "sequences")).select("seg1", "rearrangement", "homol_seq", "novel_seq")


@query(_PAIRS + "SELECT adj_id, rearrangement, CASE WHEN rearrangement = 'del' THEN break2 - break1 - 1 WHEN rearrangement NOT IN ('trl', 'ins') THEN break2 - break1 + 1 END AS size FROM merged")
def event_sizes(spark, d):
    c = F.col
    n = A.size(c("rearrangement"), c("break1"), c("break2"), F.lit(None).cast("string"), F.lit(False))
    return _places(spark, d).select("adj_id", "rearrangement", n.alias("size"))


@query(_PAIRS + "SELECT adj_id, size FROM (SELECT adj_id, CASE WHEN rearrangement = 'del' THEN break2 - break1 - 1 WHEN rearrangement NOT IN ('trl', 'ins') THEN break2 - break1 + 1 END AS size FROM merged) WHERE (size IS NULL OR size >= 50) AND size <= 40000")
def filter_adjacency_size(spark, d):
    return A.within_size(event_sizes(spark, d), 50, 40_000).select("adj_id", "size")


@query(
    _PAIRS
    + """, f AS (SELECT *, lead(adj_id) OVER w AS nid, lead(break1) OVER w AS nb, lead(o) OVER w AS no FROM (SELECT *, orient1 || orient2 AS o FROM merged WHERE rearrangement = 'inv') WINDOW w AS (PARTITION BY chrom1 ORDER BY break1, adj_id)),
r AS (SELECT *, coalesce(nb - break1 <= 25 AND no <> o AND o IN ('LL', 'RR'), false) AS flag, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY chrom1 ORDER BY break1, adj_id)),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY chrom1 ORDER BY rn) AS run FROM r WHERE flag),
h AS (SELECT *, row_number() OVER (PARTITION BY chrom1, run ORDER BY rn) AS k FROM g)
SELECT chrom1, CASE WHEN o = 'LL' THEN adj_id ELSE nid END AS adj1, CASE WHEN o = 'LL' THEN nid ELSE adj_id END AS adj2 FROM h WHERE k % 2 = 1"""
)
def pair_inversions(spark, d):
    return A.pair_inversions(_places(spark, d))


@query(
    _PAIRS
    + """, f AS (SELECT *, lead(adj_id) OVER w AS nid, lead(break1) OVER w AS nb1, lead(chrom2) OVER w AS nc2, lead(break2) OVER w AS nb2, lead(o) OVER w AS no FROM (SELECT *, orient1 || orient2 AS o FROM merged WHERE rearrangement = 'trl') WINDOW w AS (PARTITION BY chrom1 ORDER BY break1, adj_id)),
r AS (SELECT *, coalesce(nc2 = chrom2 AND abs(nb1 - break1) <= 10000 AND abs(nb2 - break2) <= 10000 AND (o || no) IN ('LRRL', 'RLLR', 'LLRR', 'RRLL'), false) AS flag, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY chrom1 ORDER BY break1, adj_id)),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY chrom1 ORDER BY rn) AS run FROM r WHERE flag),
h AS (SELECT *, row_number() OVER (PARTITION BY chrom1, run ORDER BY rn) AS k FROM g)
SELECT chrom1, adj_id AS adj1, nid AS adj2 FROM h WHERE k % 2 = 1"""
)
def pair_reciprocal_trls(spark, d):
    return A.pair_translocations(_places(spark, d).withColumn("dubious", F.lit(False)))


def _with_spans(spark, d):
    """Merged adjacencies with the spans of the first contig's segments on each side."""
    seg = _segments(spark, d)
    side = lambda k: seg.select(F.col("seg_id").alias(f"seg{k}"), F.col("tstart").alias(f"s{k}"), F.col("tend").alias(f"e{k}"))
    rows = _classified(spark, d).join(side(1), "seg1").join(side(2), "seg2")
    pick = lambda a, b: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))
    rows = rows.withColumns({"seq_no": F.col("seg1"), "span1_start": pick("s1", "s2"), "span1_end": pick("e1", "e2"), "span2_start": pick("s2", "s1"), "span2_end": pick("e2", "e1")})
    spans = ["span1_start", "span1_end", "span2_start", "span2_end"]
    out = A.merge(rows, extra=spans).withColumn("dubious", F.lit(False))
    return out.withColumns({c: F.get("members", F.lit(0))[c] for c in ["contig", *spans]})


# SQL of insertions and of the assembly of variants. Greedy choice in SQL: rounds that take what no live candidate before it touches.
_SPANNED = (
    _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, sided AS (SELECT c.*, CASE WHEN swapped THEN b.tstart ELSE a.tstart END AS s1, CASE WHEN swapped THEN b.tend ELSE a.tend END AS e1, CASE WHEN swapped THEN a.tstart ELSE b.tstart END AS s2, CASE WHEN swapped THEN a.tend ELSE b.tend END AS e2
      FROM classified c JOIN segments a ON a.seg_id = seg1 JOIN segments b ON b.seg_id = seg2),
ws AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rearrangement, chrom1, break1, orient1, chrom2, break2, orient2) AS adj_id, rearrangement, chrom1, break1, orient1, chrom2, break2, orient2,
      arg_min(query, seg1) AS contig, arg_min(s1, seg1) AS span1_start, arg_min(e1, seg1) AS span1_end, arg_min(s2, seg1) AS span2_start, arg_min(e2, seg1) AS span2_end FROM sided GROUP BY rearrangement, chrom1, break1, orient1, chrom2, break2, orient2)"""
)


def _near(alias: str, place: str, most: int) -> str:
    """The bins of ``place``, and those next to them, as a join side."""
    return f"(SELECT *, unnest([{place} // {most} - 1, {place} // {most}, {place} // {most} + 1]) AS bin FROM {alias})"


def _between_sql(src: str, name: str, first: bool, most: int = 500) -> str:
    """CTEs up to ``name`` (i, j, chrom, pos1, pos2, insertion_size): what insertions_between takes from the events ``src``."""
    t, o = ("1", "2") if first else ("2", "1")
    return f""", {name}_s AS (SELECT adj_id AS id, chrom{t} AS tc, break{t} AS tp, orient{t} AS tor, chrom{o} AS sc, break{o} AS sp, orient{o} AS so, span{o}_start AS ss, span{o}_end AS se FROM {src}),
{name}_c AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.tc AS chrom, a.tp AS pos1, b.tp AS pos2, abs(a.sp - b.sp) + 1 AS insertion_size FROM {name}_s a JOIN {_near(name + "_s", "tp", most)} b ON a.tc = b.tc AND a.sc = b.sc AND a.tp // {most} = b.bin
  WHERE abs(a.tp - b.tp) <= {most} AND a.id <> b.id AND a.tor <> b.tor AND a.sp = least(a.ss, a.se, b.ss, b.se) AND b.sp = greatest(a.ss, a.se, b.ss, b.se) AND ((a.so = 'L' AND b.so = 'R' AND b.sp < a.sp) OR (a.so = 'R' AND b.so = 'L' AND a.sp < b.sp))),
{name}_r AS (SELECT i, j, false AS taken FROM {name}_c UNION ALL SELECT i, j, taken FROM (
  WITH live AS (SELECT i, j FROM {name}_r WHERE NOT taken), low AS (SELECT x, min(src) AS m FROM (SELECT i AS x, i AS src FROM live UNION ALL SELECT j, i FROM live) GROUP BY x),
  ok AS (SELECT l.i FROM live l JOIN low a ON a.x = l.i JOIN low b ON b.x = l.j GROUP BY l.i HAVING min(a.m) >= l.i AND min(b.m) >= l.i),
  used AS (SELECT i AS x FROM live WHERE i IN (SELECT i FROM ok) UNION SELECT j FROM live WHERE i IN (SELECT i FROM ok))
  SELECT i, j, true AS taken FROM live WHERE i IN (SELECT i FROM ok) UNION ALL SELECT i, j, false FROM live WHERE i NOT IN (SELECT x FROM used) AND j NOT IN (SELECT x FROM used))),
{name} AS MATERIALIZED (SELECT c.* FROM {name}_c c JOIN {name}_r r ON r.i = c.i AND r.j = c.j AND taken)"""


def _imprecise_sql(src: str, name: str, most: int = 50) -> str:
    """CTEs up to ``name`` (i, j, t1, t2, chrom, pos1, pos2, insertion_size): what imprecise_insertions takes from the events ``src``."""
    side = lambda t, o: f"SELECT adj_id AS id, {t} AS t, chrom{t} AS tc, break{t} AS tp, orient{t} AS tor, chrom{o} AS sc, break{o} AS sp, orient{o} AS so, span{t}_start AS ts, contig FROM {src}"
    faces = lambda x, y: f"({x}.ts < {y}.ts AND {x}.tor = 'L' AND {y}.tor = 'R' AND (({x}.sp < {y}.sp AND {x}.so = 'R' AND {y}.so = 'L') OR ({x}.sp > {y}.sp AND {x}.so = 'L' AND {y}.so = 'R')))"
    return f""", {name}_s AS MATERIALIZED ({side(1, 2)} UNION ALL {side(2, 1)}),
{name}_c AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.t AS t1, b.t AS t2, a.contig AS x, b.contig AS y, a.tc AS chrom, least(a.tp, b.tp) AS pos1, greatest(a.tp, b.tp) AS pos2, CASE WHEN a.sc = b.sc THEN abs(a.sp - b.sp) + 1 END AS insertion_size, row_number() OVER (ORDER BY a.id, b.id) AS k FROM {name}_s a JOIN {_near(name + "_s", "tp", most)} b ON a.tc = b.tc AND a.tp // {most} = b.bin
  WHERE abs(a.tp - b.tp) <= {most} AND a.id < b.id AND a.contig <> b.contig AND a.tor <> b.tor AND (a.sc <> b.sc OR (abs(a.sp - b.sp) > {most} AND ({faces("a", "b")} OR {faces("b", "a")}))) QUALIFY row_number() OVER (PARTITION BY a.id, b.id ORDER BY a.t DESC, b.t DESC) = 1),
{name}_r AS (SELECT x, y, k, false AS taken FROM {name}_c UNION ALL SELECT x, y, k, taken FROM (
  WITH live AS (SELECT x, y, k FROM {name}_r WHERE NOT taken), low AS (SELECT c, min(k) AS m FROM (SELECT x AS c, k FROM live UNION ALL SELECT y, k FROM live) GROUP BY c),
  ok AS (SELECT l.* FROM live l JOIN low a ON a.c = l.x AND a.m = l.k JOIN low b ON b.c = l.y AND b.m = l.k), used AS (SELECT x AS c FROM ok UNION SELECT y FROM ok)
  SELECT x, y, k, true AS taken FROM ok UNION ALL SELECT x, y, k, false FROM live WHERE x NOT IN (SELECT c FROM used) AND y NOT IN (SELECT c FROM used))),
{name} AS MATERIALIZED (SELECT c.* FROM {name}_c c JOIN {name}_r r ON r.k = c.k AND taken)"""


def _neighbours_sql(src: str, name: str, condition: str) -> str:
    """CTE ``name`` (chrom1, first, second, o): neighbours in ``src`` (adj_id, chrom1, break1, chrom2, break2, o) paired from the left of each run."""
    return f""", {name} AS (WITH f AS (SELECT *, lead(adj_id) OVER w AS nid, lead(break1) OVER w AS nb1, lead(chrom2) OVER w AS nc2, lead(break2) OVER w AS nb2, lead(o) OVER w AS no, row_number() OVER w AS rn FROM {src} WINDOW w AS (PARTITION BY chrom1 ORDER BY break1, adj_id)),
  g AS (SELECT *, rn - row_number() OVER (PARTITION BY chrom1 ORDER BY rn) AS run FROM f WHERE coalesce({condition}, false)), h AS (SELECT *, row_number() OVER (PARTITION BY chrom1, run ORDER BY rn) AS k FROM g)
  SELECT chrom1, adj_id AS first, nid AS second, o FROM h WHERE k % 2 = 1)"""


_TRL = _SPANNED + ", trl AS (SELECT * FROM ws WHERE rearrangement = 'trl')"


@query(_TRL + _between_sql("trl", "got", True) + "SELECT i AS adj1, j AS adj2, chrom, pos1, pos2, insertion_size FROM got")
def interchrom_insertions(spark, d):
    return A.insertions_between(_with_spans(spark, d).where("rearrangement = 'trl'"))


@query(_TRL + _imprecise_sql("trl", "got") + "SELECT i AS adj1, j AS adj2, t1, t2, chrom, pos1, pos2, insertion_size FROM got")
def imprecise_insertions(spark, d):
    return A.imprecise_insertions(_with_spans(spark, d).where("rearrangement = 'trl'"))


def _left_sql(src: str, used: str, name: str) -> str:
    return f", {name} AS MATERIALIZED (SELECT * FROM {src} WHERE adj_id NOT IN ({used}))"


@query(
    _SPANNED
    + ", e1 AS (SELECT * FROM ws WHERE rearrangement NOT IN ('trl', 'ins'))"
    + _between_sql("e1", "v1", True) + _left_sql("ws", "SELECT i FROM v1 UNION ALL SELECT j FROM v1", "r1") + ", e2 AS (SELECT * FROM r1 WHERE rearrangement NOT IN ('trl', 'ins'))"
    + _between_sql("e2", "v2", False) + _left_sql("r1", "SELECT i FROM v2 UNION ALL SELECT j FROM v2", "r2") + ", e3 AS (SELECT * FROM r2 WHERE rearrangement <> 'inv')"
    + _imprecise_sql("e3", "v3") + _left_sql("r2", "SELECT i FROM v3 UNION ALL SELECT j FROM v3", "r3")
    + ", i4 AS (SELECT adj_id, chrom1, break1, chrom2, break2, orient1 || orient2 AS o FROM r3 WHERE rearrangement = 'inv')"
    + _neighbours_sql("i4", "v4", "nb1 - break1 <= 25 AND no <> o AND o IN ('LL', 'RR') AND no IN ('LL', 'RR')") + _left_sql("r3", "SELECT first FROM v4 UNION ALL SELECT second FROM v4", "r4")
    + ", e5 AS (SELECT * FROM r4 WHERE rearrangement = 'trl')" + _between_sql("e5", "v5", True) + _left_sql("r4", "SELECT i FROM v5 UNION ALL SELECT j FROM v5", "r5")
    + ", e6 AS (SELECT * FROM r5 WHERE rearrangement = 'trl')" + _between_sql("e6", "v6", False) + _left_sql("r5", "SELECT i FROM v6 UNION ALL SELECT j FROM v6", "r6")
    + ", t7 AS (SELECT adj_id, chrom1, break1, chrom2, break2, orient1 || orient2 AS o FROM r6 WHERE rearrangement = 'trl')"
    + _neighbours_sql("t7", "v7", "nc2 = chrom2 AND abs(nb1 - break1) <= 10000 AND abs(nb2 - break2) <= 10000 AND o || no IN ('LRRL', 'RLLR', 'LLRR', 'RRLL')") + _left_sql("r6", "SELECT first FROM v7 UNION ALL SELECT second FROM v7", "r7")
    + """SELECT i || '-' || j AS variant_id, 'INS' AS event, chrom, pos1 AS pos, i || ',' || j AS adj_ids, pos2, insertion_size
      FROM (FROM v1 UNION ALL FROM v2 UNION ALL FROM v5 UNION ALL FROM v6 UNION ALL SELECT i, j, chrom, pos1, pos2, insertion_size FROM v3)
    UNION ALL SELECT CASE WHEN o = 'LL' THEN first || '-' || second ELSE second || '-' || first END, 'INV', chrom1, NULL, CASE WHEN o = 'LL' THEN first || ',' || second ELSE second || ',' || first END, NULL, NULL FROM v4
    UNION ALL SELECT first || '-' || second, 'TRL', chrom1, NULL, first || ',' || second, NULL, NULL FROM v7
    UNION ALL SELECT adj_id::VARCHAR, upper(rearrangement), chrom1, break1, adj_id::VARCHAR, NULL, NULL FROM r7"""
)
def assemble_variants(spark, d):
    rows = V.assemble(_with_spans(spark, d))
    return rows.withColumn("adj_ids", F.array_join("adj_ids", ","))


@query(
    ctes("segments")
    + """SELECT a.query, a.seg_id AS i, b.seg_id AS j, greatest(0, a.qend - b.qstart + 1) AS overlap, greatest(0, b.qstart - a.qend - 1) AS gap FROM segments a JOIN segments b ON a.query = b.query
    WHERE b.qstart > a.qstart AND b.qend > a.qend AND greatest(0, a.qend - b.qstart + 1) / least(a.qend - a.qstart + 1, b.qend - b.qstart + 1) < 0.2 AND greatest(0, b.qstart - a.qend - 1) / least(a.qend - a.qstart + 1, b.qend - b.qstart + 1) < 0.2"""
)
def segment_graph_edges(spark, d):
    return S.edges(_segments(spark, d)).withColumns({c: F.col(c).cast("bigint") for c in ("overlap", "gap")})


_PATHS = (
    ctes("segments").replace("WITH ", "WITH RECURSIVE ")
    + """, e AS (SELECT a.query, a.seg_id AS i, b.seg_id AS j, greatest(0, a.qend - b.qstart + 1) AS o, b.qend AS qe, b.target AS target, b.qend - b.qstart + 1 AS len FROM segments a JOIN segments b ON a.query = b.query
    WHERE b.qstart > a.qstart AND b.qend > a.qend AND greatest(0, a.qend - b.qstart + 1) / least(a.qend - a.qstart + 1, b.qend - b.qstart + 1) < 0.2 AND greatest(0, b.qstart - a.qend - 1) / least(a.qend - a.qstart + 1, b.qend - b.qstart + 1) < 0.2),
w AS (SELECT query, query_len, [seg_id] AS path, [target] AS targets, seg_id AS at, qstart AS qs, qend AS qe, qend - qstart + 1 AS total, 0::BIGINT AS o FROM segments WHERE qstart <= greatest(1, floor(query_len * 0.02))
  UNION ALL SELECT w.query, query_len, list_append(path, j), list_append(targets, e.target), j, qs, e.qe, total + len, w.o + e.o FROM w JOIN e ON w.at = e.i),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY path) AS n FROM w WHERE qe >= query_len - greatest(1, floor(query_len * 0.02)) + 1 AND (qe - qs + 1) / query_len >= 0.95)"""
)


@query(_PATHS + "SELECT query, array_to_string(path, '-') AS path, o AS overlapped, total - o AS covered, n FROM f")
def segment_paths(spark, d):
    return S.paths(_segments(spark, d)).select("query", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "overlapped", "covered", "n")


@query(
    _PATHS
    + """, g AS (SELECT query, n, path, o, total - o AS c, len(list_distinct(targets)) AS k FROM f),
    b AS (SELECT * FROM g WHERE n = 1 UNION ALL SELECT g.query, g.n, CASE WHEN x.better THEN g.path ELSE b.path END, CASE WHEN x.better THEN g.o ELSE b.o END, CASE WHEN x.better THEN g.c ELSE b.c END, CASE WHEN x.better THEN g.k ELSE b.k END
      FROM b JOIN g ON g.query = b.query AND g.n = b.n + 1, LATERAL (SELECT g.c > b.c OR g.o < b.o OR g.k < b.k AS better) x)
    SELECT query, array_to_string(path, '-') AS path, c AS covered, o AS overlapped FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC) = 1"""
)
def best_paths(spark, d):
    return S.best_path(S.paths(_segments(spark, d))).select("query", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "covered", "overlapped")


@query(
    ctes("segments")
    + """, v AS (SELECT *, count(*) FILTER (is_primary) OVER w AS np, count(*) FILTER (is_primary AND NOT (qstart > 0 AND tstart > 0 AND qend > qstart AND tend > tstart)) OVER w AS bad,
    count(*) FILTER (NOT is_primary AND qstart = 1 AND qend = query_len) OVER w AS whole FROM segments WINDOW w AS (PARTITION BY query))
    SELECT seg_id, query, is_primary FROM v WHERE np BETWEEN 2 AND 3 AND bad = 0 AND whole = 0 AND (is_primary OR (qstart > 0 AND tstart > 0 AND qend > qstart AND tend > tstart))"""
)
def chimera_candidates(spark, d):
    return S.chimera_candidates(_segments(spark, d)).select("seg_id", "query", "is_primary")


_NEAR = "b.qstart > a.qstart AND b.qend > a.qend AND greatest(0, a.qend - b.qstart + 1) / least(a.qend - a.qstart + 1, b.qend - b.qstart + 1) < 0.2 AND greatest(0, b.qstart - a.qend - 1) / least(a.qend - a.qstart + 1, b.qend - b.qstart + 1) < 0.2"
_STARTS, _ENDS = "qstart <= greatest(1, floor(query_len * 0.02))", "qend >= query_len - greatest(1, floor(query_len * 0.02)) + 1"


def _chains(pool: str) -> str:
    """SQL that grows every chain of segments of ``pool`` (grp, seg_id, ...) in full: done (grp, covered, edits)."""
    return f""", e AS MATERIALIZED (SELECT a.grp, a.seg_id AS i, b.seg_id AS j, b.qend - b.qstart + 1 - greatest(0, a.qend - b.qstart + 1) AS more, b.edits, b.{_ENDS.replace("query_len", "b.query_len")} AS fin FROM {pool} a JOIN {pool} b ON a.grp = b.grp AND {_NEAR}),
chain AS (SELECT grp, seg_id AS at, qend - qstart + 1 AS covered, edits, {_ENDS} AS fin FROM {pool} WHERE {_STARTS} UNION ALL SELECT c.grp, j, covered + more, c.edits + e.edits, e.fin FROM chain c JOIN e ON c.grp = e.grp AND c.at = e.i),
done AS (SELECT grp, covered, edits FROM chain WHERE fin)"""


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark_view(spark, d, "members"), spark_view(spark, d, "alternatives")


_BOTH = ctes("members", "alternatives").replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    ctes("segments", "alternatives").replace("WITH ", "WITH RECURSIVE ", 1)
    + ", pool AS MATERIALIZED (SELECT query AS grp, seg_id, query_len, qstart, qend, (nm % 5)::BIGINT AS edits FROM segments UNION ALL SELECT query, seg_id, query_len, qstart, qend, edits FROM alternatives)"
    + _chains("pool")
    + "SELECT grp AS query, covered, edits FROM done QUALIFY row_number() OVER (PARTITION BY grp ORDER BY covered DESC, edits) = 1"
)
def end_to_end_chains(spark, d):
    own = _segments(spark, d).withColumn("edits", (F.col("nm") % 5).cast("bigint"))
    return X.end_to_end(own.select(*X.NODE).union(spark_view(spark, d, "alternatives").select(*X.NODE)))


@query(
    _BOTH
    + """, pool AS MATERIALIZED (SELECT m.query || '/' || m.seg_id AS grp, p.seg_id, p.query_len, p.qstart, p.qend, p.edits FROM members m JOIN (SELECT query, seg_id, query_len, qstart, qend, edits FROM members UNION ALL SELECT query, seg_id, query_len, qstart, qend, edits FROM alternatives) p
    ON p.query = m.query AND p.seg_id <> m.seg_id)"""
    + _chains("pool")
    + "SELECT DISTINCT split_part(grp, '/', 1) AS query, split_part(grp, '/', 2)::BIGINT AS seg_id FROM done"
)
def dubious_segments(spark, d):
    return X.replaceable(*_both(spark, d))


@query(
    _BOTH
    + ", pool AS MATERIALIZED (SELECT query AS grp, * FROM alternatives WHERE query IN (SELECT query FROM members))"
    + _chains("pool")
    + """, span AS (SELECT query, edits, qend - greatest(qstart, coalesce(max(qend) OVER (PARTITION BY query ORDER BY qstart, qend, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, qstart)) + 1 AS own FROM members),
    mine AS (SELECT query, sum(greatest(own, 0)) AS covered, sum(edits) AS edits FROM span GROUP BY query)
    SELECT DISTINCT query FROM mine m JOIN done d ON d.grp = m.query WHERE d.covered > m.covered OR (d.covered = m.covered AND d.edits <= m.edits)"""
)
def outdone_chimeras(spark, d):
    return X.outdone(*_both(spark, d))


@query(
    ctes("members", "alternatives")
    + f""", several AS (SELECT query FROM members GROUP BY query HAVING count(DISTINCT target) > 1),
    pool AS (SELECT m.query, m.seg_id AS of, p.* EXCLUDE (query) FROM members m JOIN (SELECT *, true AS member FROM members UNION ALL BY NAME SELECT *, false AS member FROM alternatives) p
      ON p.query = m.query AND p.target = m.target AND (p.seg_id = m.seg_id OR NOT p.member) WHERE m.query IN (SELECT query FROM several)),
    pair AS (SELECT a.query, a.of, a.seg_id AS seg1, b.seg_id AS seg2, abs(a.tstart - b.tstart) AS span FROM pool a JOIN pool b ON a.query = b.query AND a.of = b.of AND {_NEAR} WHERE a.{_STARTS.replace("query_len", "a.query_len")} AND b.{_ENDS.replace("query_len", "b.query_len")})
    SELECT query, seg1, seg2, span FROM pair WHERE span < 1000000 QUALIFY row_number() OVER (PARTITION BY query ORDER BY of, span, seg1, seg2) = 1"""
)
def translocation_swaps(spark, d):
    return X.same_target(*_both(spark, d))


_REGIONS = """SELECT 'chr' || CAST(s_suppkey % 3 + 1 AS STRING) AS chrom, (s_suppkey * 977) % 90000 AS start, (s_suppkey * 977) % 90000 + 300 + s_nationkey * 10 AS stop FROM supplier"""


@query(ctes("segments") + f", r AS ({_REGIONS}), hit AS (SELECT DISTINCT query FROM segments JOIN r ON target = chrom AND tstart <= stop AND start <= tend) SELECT seg_id, query FROM segments WHERE query NOT IN (SELECT query FROM hit)")
def acen_anti_join(spark, d):
    regions = spark.sql(_REGIONS.replace("FROM supplier", "FROM {supplier}"), supplier=spark_view(spark, d, "supplier"))
    return I.without_overlap(_segments(spark, d), regions, [("target", "chrom")], ("tstart", "tend"), ("start", "stop"), ["query"]).select("seg_id", "query")


@query(_PAIRS + f", r AS ({_REGIONS}) SELECT adj_id FROM merged m WHERE NOT EXISTS (SELECT 1 FROM r WHERE (chrom = chrom1 AND break1 BETWEEN start AND stop) OR (chrom = chrom2 AND break2 BETWEEN start AND stop))")
def bad_region_anti_join(spark, d):
    regions = spark.sql(_REGIONS.replace("FROM supplier", "FROM {supplier}"), supplier=spark_view(spark, d, "supplier"))
    ends = _places(spark, d).select("adj_id", F.explode(F.array(*[F.struct(F.col(f"chrom{k}").alias("c"), F.col(f"break{k}").alias("b")) for k in (1, 2)])).alias("x")).select("adj_id", F.col("x.c").alias("c"), F.col("x.b").alias("b"), F.col("x.b").alias("b2"))
    return I.without_overlap(ends, regions, [("c", "chrom")], ("b", "b2"), ("start", "stop"), ["adj_id"]).select("adj_id").distinct()


@query(ctes("segments") + f", r AS ({_REGIONS}) SELECT seg_id, start, stop FROM segments JOIN r ON target = chrom AND tstart <= stop AND start <= tend")
def interval_overlap_join(spark, d):
    regions = spark.sql(_REGIONS.replace("FROM supplier", "FROM {supplier}"), supplier=spark_view(spark, d, "supplier"))
    return I.overlap_join(_segments(spark, d).select("seg_id", "target", "tstart", "tend"), regions, [("target", "chrom")], ("tstart", "tend"), ("start", "stop")).select("seg_id", "start", "stop")


@query(ctes("sequences") + "SELECT name, translate(reverse(seq), 'agtcAGTC', 'tcagTCAG') AS rc FROM sequences")
def reverse_complement(spark, d):
    return spark_view(spark, d, "sequences").select("name", Q.reverse_complement(F.col("seq")).alias("rc"))


_PIECES = ctes("sequences") + ", p AS (SELECT name, k, substr(seq, k * 3 + 1, 6) AS piece FROM (SELECT name, seq, unnest(range(0, (length(seq) - 3) // 3)) AS k FROM sequences WHERE length(seq) >= 6))"


def _pieces(spark, d):
    """All pieces of six letters that begin at every third, over whole sequences."""
    rows = Q.pieces(spark_view(spark, d, "sequences"), 1, F.length("seq") - 5, 3, 6, ["name"])
    return rows.select("name", F.floor(F.col("k") / 3).alias("k"), "piece")


@query(_PIECES + "SELECT name, k, CASE WHEN piece = repeat(piece[1:1], 6) THEN piece[1:1] WHEN piece = repeat(piece[1:2], 3) THEN piece[1:2] WHEN piece = repeat(piece[1:3], 2) THEN piece[1:3] END AS unit FROM p")
def tandem_repeat_unit(spark, d):
    return _pieces(spark, d).select("name", "k", Q.repeat_unit(F.col("piece")).alias("unit"))


@query(_PIECES + "SELECT name, k, piece = repeat(piece[1:1], 6) AS homopolymer, greatest(length(piece) - length(replace(piece, 'A', '')), length(piece) - length(replace(piece, 'C', '')), length(piece) - length(replace(piece, 'G', '')), length(piece) - length(replace(piece, 'T', ''))) >= 4.2 AS fragment FROM p")
def homopolymers(spark, d):
    return _pieces(spark, d).select("name", "k", Q.is_homopolymer(F.col("piece")).alias("homopolymer"), Q.is_homopolymer_fragment(F.col("piece")).alias("fragment"))


@query(
    ctes("sequences")
    + """, c AS (SELECT name, seq, k, substr(seq, k, 2) AS unit FROM (SELECT *, unnest(range(11, length(seq) - 1, 10)) AS k FROM sequences WHERE length(seq) >= 40)),
    r AS (SELECT name, k, unit, reverse(left(seq, k - 1)) AS up, substr(seq, k + 2) AS down FROM c)
    SELECT name, k, (length(regexp_extract(up, '^(?:' || reverse(unit) || ')*')) // 2)::INT AS before, (length(regexp_extract(down, '^(?:' || unit || ')*')) // 2)::INT AS after FROM r"""
)
def flanking_copy_count(spark, d):
    return Q.copies_around(spark_view(spark, d, "sequences"), 11, F.when(F.length("seq") >= 40, F.length("seq") - 2), 10, 2, ["name"])


def _share(base: str) -> str:
    return f"(length(s) - length(replace(s, '{base}', '')))"


@query(ctes("sequences") + f", q AS (SELECT name, seq AS s FROM sequences) SELECT name, greatest({', '.join(_share(b) for b in ('A', 'G', 'T', 'C', 'AG', 'AT', 'AC', 'GT', 'GC', 'TC'))}) > length(s) * 0.5 AS low FROM q")
def low_complexity(spark, d):
    return spark_view(spark, d, "sequences").select("name", Q.is_low_complexity(F.col("seq"), 0.5).alias("low"))


@query(_PAIRS + ctes("sequences").replace("WITH ", ", ") + "SELECT seg1, upper(substr(seq, greatest(least(cb1, cb2) - 24, 1), least(greatest(cb1, cb2) + 24, length(seq)) - greatest(least(cb1, cb2) - 24, 1) + 1)) AS probe FROM classified JOIN sequences ON query = name WHERE length(seq) >= greatest(cb1, cb2)")
def probe_extract(spark, d):
    rows = _classified(spark, d).join(spark_view(spark, d, "sequences"), F.col("query") == F.col("name")).where(F.length("seq") >= F.greatest("cb1", "cb2"))
    return rows.select("seg1", Q.probe(F.col("seq"), F.col("cb1"), F.col("cb2")).alias("probe"))


_CIGARS = "SELECT l_orderkey * 100 + rn AS seg_id, CASE WHEN l_partkey % 3 = 0 THEN '5S' ELSE '' END || '40M' || CASE l_suppkey % 4 WHEN 0 THEN '7D' WHEN 1 THEN '6I' WHEN 2 THEN '100N' ELSE '2N' END || '30M' || CASE WHEN l_partkey % 2 = 0 THEN '4I3D20M' ELSE '' END AS cigar, l_partkey AS pos, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM items"


def _cigars(spark, d):
    rows = spark.sql(_CIGARS.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items"))
    return rows.withColumn("text", F.col("cigar")).withColumn("cigar", C.parse_cigar(F.col("cigar")))


# Each piece of these CIGARs has a fixed effect, so the blocks can be written down without a fold.
_BLOCK_SQL = (
    ctes("items")
    + f""", c AS ({_CIGARS}), l AS (SELECT *, CASE WHEN starts_with(cigar, '5S') THEN 5 ELSE 0 END AS clip, CASE WHEN cigar LIKE '%7D%' THEN 7 WHEN cigar LIKE '%100N%' THEN 100 ELSE 0 END AS tg, CASE WHEN cigar LIKE '%6I%' THEN 6 ELSE 0 END AS qg, cigar LIKE '%20M' AS third FROM c),
    n AS (SELECT *, clip + 70 + qg + CASE WHEN third THEN 24 ELSE 0 END AS qlen FROM l),
    b AS (SELECT *, CASE WHEN strand = '+' THEN 1 ELSE -1 END AS sg, CASE WHEN strand = '+' THEN 1 + clip ELSE qlen - clip END AS q FROM n)"""
)


@query(
    _BLOCK_SQL
    + """SELECT seg_id, qlen::INT AS query_len, pos || '-' || (pos + 39) || ':' || q || '-' || (q + sg * 39) || ',' || (pos + 40 + tg) || '-' || (pos + 69 + tg) || ':' || (q + sg * (40 + qg)) || '-' || (q + sg * (69 + qg))
    || CASE WHEN third THEN ',' || (pos + 73 + tg) || '-' || (pos + 92 + tg) || ':' || (q + sg * (74 + qg)) || '-' || (q + sg * (93 + qg)) ELSE '' END AS blocks FROM b"""
)
def cigar_blocks(spark, d):
    rows = _cigars(spark, d)
    text = F.array_join(F.transform(C.blocks(F.col("cigar"), F.col("pos"), F.col("strand")), lambda b: F.concat(b["ts"], F.lit("-"), b["te"], F.lit(":"), b["qs"], F.lit("-"), b["qe"])), ",")
    return rows.select("seg_id", C.query_length(F.col("cigar")).alias("query_len"), text.alias("blocks"))


@query(_BLOCK_SQL + "SELECT seg_id, 0 AS i, tg::BIGINT AS tgap, qg::BIGINT AS qgap FROM b UNION ALL SELECT seg_id, 1, 3, 4 FROM b WHERE third")
def block_gaps(spark, d):
    rows = _cigars(spark, d).select("seg_id", F.explode(C.gaps(C.blocks(F.col("cigar"), F.col("pos"), F.col("strand")))).alias("g"))
    return rows.select("seg_id", "g.i", "g.tgap", "g.qgap")


@query(_BLOCK_SQL + "SELECT seg_id, CASE WHEN strand = '+' THEN pos + 20 - q ELSE pos + q - 20 END AS lifted FROM b WHERE CASE WHEN strand = '+' THEN 20 BETWEEN q AND q + 39 ELSE 20 BETWEEN q - 39 AND q END UNION ALL SELECT seg_id, CASE WHEN strand = '+' THEN NULL ELSE pos + 40 + tg + q - 40 - qg - 20 END FROM b WHERE strand = '-' AND 20 BETWEEN q - 69 - qg AND q - 40 - qg UNION ALL SELECT seg_id, pos + 73 + tg + q - 74 - qg - 20 FROM b WHERE strand = '-' AND third AND 20 BETWEEN q - 93 - qg AND q - 74 - qg")
def query_position_lift(spark, d):
    lifted = C.lift(C.blocks(F.col("cigar"), F.col("pos"), F.col("strand")), F.col("strand"), F.lit(20))
    # Exploded, not filtered: Spark moves a filter below the CIGARs and works all of them out twice.
    return _cigars(spark, d).select("seg_id", F.explode(F.filter(F.array(lifted), lambda x: x.isNotNull())).alias("lifted"))


@query(
    _BLOCK_SQL
    + ", "
    + ctes("sequences").removeprefix("WITH ")
    + """, e AS (SELECT seg_id, floor(seg_id / 100)::BIGINT::VARCHAR AS query, strand, 0 AS gap, pos + 39 AS t1, pos + 40 + tg AS t2, q + sg * 39 AS q1, q + sg * (40 + qg) AS q2, tg AS tgap, qg AS qgap FROM b WHERE tg > 0 OR qg > 0
      UNION ALL SELECT seg_id, floor(seg_id / 100)::BIGINT::VARCHAR, strand, 1, pos + 69 + tg, pos + 73 + tg, q + sg * (69 + qg), q + sg * (74 + qg), 3, 4 FROM b WHERE third),
    g AS (SELECT e.*, seq, CASE WHEN tgap = 0 THEN substr(seq, least(q1, q2) + 1, qgap) END AS ch FROM e JOIN sequences ON name = query),
    u AS (SELECT *, length(ch) AS n, CASE WHEN length(ch) > 0 AND ch = repeat(ch[1], length(ch)) THEN ch[1] WHEN length(ch) = 4 AND ch = repeat(ch[1:2], 2) THEN ch[1:2] WHEN length(ch) = 6 AND ch = repeat(ch[1:2], 3) THEN ch[1:2] WHEN length(ch) = 6 AND ch = repeat(ch[1:3], 2) THEN ch[1:3] END AS unit FROM g),
    r AS (SELECT *, coalesce(length(regexp_extract(reverse(left(seq, least(q1, q2))), '^(?:' || reverse(unit) || ')*')) // length(unit), 0) AS bef, substr(seq, greatest(q1, q2)) AS rest, regexp_extract(substr(seq, greatest(q1, q2)), '^(?:' || unit || ')*') AS run FROM u),
    k AS (SELECT *, coalesce(length(run) // length(unit) - CASE WHEN run <> '' AND length(run) = length(rest) THEN 1 ELSE 0 END, 0) AS aft, strand = '+' AS fw FROM r),
    o AS (SELECT *, bef > 0 OR aft > 0 AS copied, tgap = 0 AND (bef > 0 OR aft > 0) AS dup, (bef > 0) = fw AS low, coalesce(length(unit), 0) AS wide, n // length(unit) AS times FROM k)
    SELECT seg_id, query, gap::INT AS gap, 'chr1' AS target, strand, CASE WHEN tgap > 0 THEN CASE WHEN qgap = 0 THEN 'del' ELSE 'indel' END WHEN dup THEN 'dup' ELSE 'ins' END AS rearrangement,
      CASE WHEN dup AND low THEN t1 - n ELSE t1 END AS break1, CASE WHEN tgap > 0 THEN t2 WHEN dup THEN CASE WHEN low THEN t1 + 1 ELSE t1 + n + 1 END ELSE t1 END AS break2, q1 - wide * bef AS cb1, q2 + wide * aft AS cb2,
      CASE WHEN tgap = 0 THEN CASE WHEN fw THEN ch ELSE translate(reverse(ch), 'ACGT', 'TGCA') END END AS novel_seq, CASE WHEN dup THEN CASE WHEN fw THEN unit ELSE translate(reverse(unit), 'ACGT', 'TGCA') END END AS repeat_seq,
      CASE WHEN dup THEN times::INT END AS repeat_num, CASE WHEN dup THEN (bef + aft) || '>' || (bef + aft + times) END AS repeat_change FROM o"""
)
def gapped_indels(spark, d):
    rows = S.to_segments(_cigars(spark, d)).withColumn("query", F.floor(F.col("seg_id") / 100).cast("string")).withColumn("target", F.lit("chr1"))
    return S.gapped_indels(rows, spark_view(spark, d, "sequences"))


_ALIGN = "SELECT l_orderkey AS query, rn, CASE WHEN l_suppkey % 7 = 0 THEN 'chr1_alt' ELSE 'chr1' END AS target, CASE WHEN l_partkey % 3 = 0 THEN 256 ELSE 0 END AS flag, CASE WHEN l_suppkey % 2 = 0 THEN '10S90M' ELSE '100M' END AS cigar FROM items"


@query(
    ctes("items")
    + f""", a AS ({_ALIGN}), f AS (SELECT *, cigar LIKE '%S%' AND flag = 0 AS first, contains(target, '_') AS alt FROM a), g AS (SELECT *, count(*) FILTER (first) OVER w > 1 AND count(*) FILTER (first AND alt) OVER w > 0 AS swap FROM f WINDOW w AS (PARTITION BY query))
    SELECT query, rn, CASE WHEN swap THEN NOT alt ELSE first END AS is_primary FROM g"""
)
def primary_split(spark, d):
    rows = spark.sql(_ALIGN.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items")).withColumn("cigar", C.parse_cigar(F.col("cigar")))
    return S.primary_split(rows).select("query", "rn", "is_primary")


_UNIQUE = "SELECT l_orderkey AS query, l_orderkey * 100 + rn AS seg_id, CASE WHEN rn > 1 THEN 256 ELSE 0 END AS flag, CAST(l_suppkey % 5 AS INT) AS mapq, CASE WHEN l_partkey % 3 = 0 THEN '10S90M' WHEN l_partkey % 3 = 1 THEN '50M4D50M' ELSE '60M3I37M' END AS cigar, CAST(floor(l_quantity / 3) AS INT) AS nm FROM items"


@query(
    ctes("items")
    + f""", a AS ({_UNIQUE}), n AS (SELECT *, count(*) OVER (PARTITION BY query) AS k FROM a WHERE flag = 0)
    SELECT query, seg_id FROM n WHERE k = 1 AND mapq > 0 AND cigar NOT LIKE '10S%' AND nm - CASE WHEN cigar LIKE '%D%' THEN 4 ELSE 3 END <= 10"""
)
def unique_alignment_gate(spark, d):
    rows = spark.sql(_UNIQUE.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items")).withColumn("cigar", C.parse_cigar(F.col("cigar")))
    return S.unique_alignments(rows.withColumn("seq", F.repeat(F.lit("A"), F.lit(100)))).select("query", "seg_id")


_SPAN = (
    ctes("spans", "reads")
    + """, hit AS (SELECT s.contig, span1, span2, seq_no, rstart || strand AS key, name FROM spans s JOIN reads r ON s.contig = r.contig AND whole AND rstart <= span1 - 1 AND rend >= span2 + 1)"""
)


@query(
    _SPAN.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY contig, span1, span2 ORDER BY seq_no) AS n FROM hit),
    f AS (SELECT contig, span1, span2, 0::BIGINT AS n, []::VARCHAR[] AS keys, []::VARCHAR[] AS names FROM o WHERE n = 1
      UNION ALL SELECT o.contig, o.span1, o.span2, o.n, CASE WHEN x.free THEN list_append(keys, key) ELSE keys END, CASE WHEN x.free THEN list_append(names, name) ELSE names END
      FROM f JOIN o ON f.contig = o.contig AND f.span1 = o.span1 AND f.span2 = o.span2 AND o.n = f.n + 1, LATERAL (SELECT NOT list_contains(f.keys, o.key) AND NOT list_contains(f.names, o.name) AS free) x)
    SELECT contig, span1, span2, max(len(keys))::INT AS spanning FROM f GROUP BY ALL"""
)
def spanning_reads(spark, d):
    return R.spanning(spark_view(spark, d, "spans"), spark_view(spark, d, "reads"))


@query(_SPAN + "SELECT contig, span1, span2, count(*) AS n, count(DISTINCT key) AS keys FROM hit GROUP BY ALL")
def spanning_candidates(spark, d):
    s = spark_view(spark, d, "spans").withColumns({"_s": F.col("span1") - 1, "_e": F.col("span2") + 1})
    r = spark_view(spark, d, "reads").where("whole").withColumnRenamed("contig", "_c")
    pairs = I.overlap_join(s, r, [("contig", "_c")], ("_s", "_e"), ("rstart", "rend"), 200).where("rstart <= _s and rend >= _e")
    return pairs.groupBy("contig", "span1", "span2").agg(F.count("*").alias("n"), F.countDistinct(F.concat("rstart", "strand")).alias("keys"))


_FRAGS = "SELECT contig, rend AS inner1, rend + 20 + seq_no % 90 AS inner2 FROM reads WHERE strand = '+'"


@query(ctes("spans", "reads") + f", f AS ({_FRAGS}) SELECT s.contig, span1, span2, count(DISTINCT inner1 || '-' || inner2)::INT AS flanking FROM spans s JOIN f ON s.contig = f.contig AND inner1 <= span1 - 1 AND inner2 >= span2 + 1 GROUP BY ALL")
def flanking_pairs(spark, d):
    frags = spark.sql(_FRAGS.replace("FROM reads", "FROM {reads}"), reads=spark_view(spark, d, "reads"))
    return R.flanking(spark_view(spark, d, "spans"), frags)


_SUPPORT = "SELECT query AS contig, CAST(cb1 AS BIGINT) AS span1, CAST(cb2 AS BIGINT) AS span2, CAST((seg1 * 7) % 9 AS INT) AS spanning, CAST(seg1 % 4 AS INT) AS flanking FROM classified WHERE seg1 % 5 <> 0"


@query(_PAIRS + f", s AS ({_SUPPORT}) SELECT seg1, coalesce(spanning, 0) AS spanning, coalesce(flanking, 0) AS flanking FROM classified c LEFT JOIN s ON query = contig AND least(cb1, cb2) = least(span1, span2) AND greatest(cb1, cb2) = greatest(span1, span2) WHERE coalesce(spanning, 0) >= 2")
def support_join_filter(spark, d):
    rows = _classified(spark, d)
    made = spark.sql(_SUPPORT.replace("FROM classified", "FROM {classified}"), classified=rows)
    return R.with_support(rows, made).where("spanning >= 2").select("seg1", "spanning", "flanking")


@query(_PAIRS + ", n AS (SELECT DISTINCT rearrangement, chrom1, break1 FROM merged WHERE adj_id % 3 = 0) SELECT adj_id, n.break1 IS NULL AS somatic FROM merged m LEFT JOIN n USING (rearrangement, chrom1, break1)")
def somatic_subtract(spark, d):
    rows = _places(spark, d)
    return R.somatic(rows, rows.where("adj_id % 3 = 0"), ["rearrangement", "chrom1", "break1"]).select("adj_id", "somatic")


@query(_PAIRS + ", v AS (SELECT adj_id // 2 AS v, min(adj_id % 7) AS spanning, min(adj_id % 3) AS flanking FROM merged GROUP BY 1) SELECT v::VARCHAR AS variant_id, spanning, flanking FROM v WHERE spanning >= 2")
def variant_min_support(spark, d):
    rows = _places(spark, d).select("adj_id", (F.col("adj_id") % 7).alias("spanning"), (F.col("adj_id") % 3).alias("flanking"))
    variants = rows.groupBy(F.floor(F.col("adj_id") / 2).cast("string").alias("variant_id")).agg(F.collect_list("adj_id").alias("adj_ids"))
    return R.variant_support(variants, rows)


_TX = ctes("exon_rows") + """, t AS (SELECT tid, gene, chrom, strand, bool_or(coding) AS coding, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS exons, sum("end" - start + 1)::BIGINT AS length, min(start) AS first, max("end") AS last, count(*) AS n FROM exon_rows GROUP BY tid, gene, chrom, strand)"""


def _transcripts(spark, d):
    rows = spark_view(spark, d, "exon_rows")
    cds = rows.where("coding").select(F.lit("CDS").alias("feature"), "chrom", (F.col("start") + 10).alias("start"), (F.col("end") - 10).alias("end"), "strand", "gene", "tid")
    return E.build(rows.select(F.lit("exon").alias("feature"), "chrom", "start", "end", "strand", "gene", "tid").union(cds))


@query(_TX + "SELECT tid, gene, chrom, strand, coding, CASE WHEN coding THEN CASE WHEN strand = '+' THEN first + 10 ELSE last - 10 END END AS cds_start, exons FROM t")
def transcript_build(spark, d):
    text = F.array_join(F.transform("exons", lambda e: F.concat(e["start"], F.lit("-"), e["end"])), ",")
    return _transcripts(spark, d).select("tid", "gene", "chrom", "strand", "coding", "cds_start", text.alias("exons"))


@query(ctes("exon_rows") + """SELECT DISTINCT chrom, "end" AS start, nxt AS "end" FROM (SELECT chrom, "end", lead(start) OVER (PARTITION BY tid ORDER BY row) AS nxt FROM exon_rows) WHERE nxt IS NOT NULL""")
def known_junctions(spark, d):
    return E.known_junctions(spark_view(spark, d, "exon_rows"))


@query(_TX + "SELECT gene, tid, length FROM t QUALIFY row_number() OVER (PARTITION BY gene ORDER BY length DESC, tid) = 1")
def longest_transcript(spark, d):
    return E.longest_of_gene(_transcripts(spark, d)).select("gene", "tid", transcripts.length(F.col("exons")).alias("length"))


@query(_TX + 'SELECT gene, chrom, min(first) AS start, max(last) AS "end" FROM t GROUP BY gene, chrom')
def gene_extent(spark, d):
    return E.gene_extent(_transcripts(spark, d))


_NUM = ctes("exon_rows") + """, e AS (SELECT tid, strand, start, "end" AS stop, coalesce(sum("end" - start + 1) OVER (PARTITION BY tid ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM exon_rows)"""


@query(_NUM + "SELECT tid, (CASE WHEN strand = '-' THEN stop - (150 - base - 1) ELSE start + 150 - base - 1 END)::BIGINT AS gpos FROM e WHERE 150 BETWEEN base + 1 AND base + stop - start + 1")
def txt_to_genome_coord(spark, d):
    c = F.col
    return _transcripts(spark, d).select("tid", transcripts.to_genome(c("exons"), c("strand"), F.lit(150)).alias("gpos")).where("gpos is not null")


@query(_NUM + "SELECT e.tid, (CASE WHEN strand = '-' THEN base + stop - g + 1 ELSE base + g - start + 1 END)::BIGINT AS tpos FROM e JOIN (SELECT tid, min(start) + 340 AS g FROM e GROUP BY tid) m ON e.tid = m.tid AND g BETWEEN start AND stop")
def genome_to_txt_coord(spark, d):
    c = F.col
    return _transcripts(spark, d).select("tid", transcripts.to_transcript(c("exons"), c("strand"), c("exons")[0]["start"] + 340).alias("tpos")).where("tpos is not null")


@query(_TX + "SELECT tid, CASE WHEN strand = '+' THEN CASE WHEN first + 5 BETWEEN first AND first + 9 THEN 5 END ELSE CASE WHEN first + 5 BETWEEN first AND first + 10 - 4 THEN 3 END END AS utr FROM t WHERE coding")
def within_utr(spark, d):
    c = F.col
    return _transcripts(spark, d).where("coding").select("tid", transcripts.within_utr(c("exons"), c("strand"), c("cds_start"), c("cds_end"), c("exons")[0]["start"] + 5).alias("utr"))


def _two_blocks(spark, d):
    """Alignments of two blocks from each transcript with two exons or more: the first two exons, the second block cut or moved."""
    rows = _transcripts(spark, d).where("size(exons) >= 2")
    shift = F.pmod(F.col("tid").cast("bigint"), F.lit(3)) - 1
    one = F.struct(F.col("exons")[0]["start"].alias("ts"), F.col("exons")[0]["end"].alias("te"), F.lit(1).cast("bigint").alias("qs"), F.lit(60).cast("bigint").alias("qe"))
    two = F.struct((F.col("exons")[1]["start"] + shift).alias("ts"), (F.col("exons")[1]["end"] - 5).alias("te"), F.lit(61).cast("bigint").alias("qs"), F.lit(120).cast("bigint").alias("qe"))
    return rows.select(F.col("tid").cast("bigint").alias("seg_id"), F.col("tid").alias("query"), F.col("chrom").alias("target"), one["ts"].alias("tstart"), two["te"].alias("tend"), F.array(one, two).alias("blocks"))


_TWO = (
    ctes("exon_rows")
    + """, x AS (SELECT tid, gene, chrom, strand, start AS s, "end" AS e, row_number() OVER (PARTITION BY tid ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY tid) AS n FROM exon_rows),
    seg AS (SELECT a.tid::BIGINT AS seg_id, a.tid AS query, a.chrom AS target, a.s AS s1, a.e AS e1, b.s + a.tid::BIGINT % 3 - 1 AS s2, b.e - 5 AS e2 FROM x a JOIN x b ON a.tid = b.tid AND a.i = 0 AND b.i = 1),
    bl AS (SELECT seg_id, target, 0 AS b, s1 AS bs, e1 AS be FROM seg UNION ALL SELECT seg_id, target, 1, s2, e2 FROM seg),
    m AS (SELECT seg_id, b, tid, i, CASE WHEN bs = s THEN '=' WHEN bs > s THEN '>' ELSE '<' END || CASE WHEN be = e THEN '=' WHEN be > e THEN '>' ELSE '<' END AS code FROM bl JOIN x ON target = chrom AND least(be, e) - greatest(bs, s) > 0),
    ok AS (SELECT seg_id, tid FROM m JOIN (SELECT tid, max(n) AS n FROM x GROUP BY tid) c USING (tid) GROUP BY seg_id, tid HAVING max(n) = 1 OR bool_or(contains(code, '=')))"""
)


@query(_TWO + "SELECT seg_id, tid, string_agg(b || ':' || i || code, ',' ORDER BY b, i) AS codes FROM m JOIN ok USING (seg_id, tid) GROUP BY seg_id, tid")
def block_exon_codes(spark, d):
    return E.mapping_codes(_two_blocks(spark, d), _transcripts(spark, d))


@query(
    _TWO
    + """, a AS (SELECT seg_id, tid, b, count(*) AS k, min(i) AS i0, max(i) AS i1, arg_min(code, i) AS c0, arg_max(code, i) AS c1 FROM m JOIN ok USING (seg_id, tid) GROUP BY seg_id, tid, b),
    z AS (SELECT o.seg_id, o.tid, p.k AS k0, q.k AS k1, p.i0 AS pi0, p.i1 AS pi1, q.i0 AS qi0, q.i1 AS qi1, p.c0 AS pc0, p.c1 AS pc1, q.c0 AS qc0, q.c1 AS qc1 FROM ok o LEFT JOIN a p ON o.seg_id = p.seg_id AND o.tid = p.tid AND p.b = 0 LEFT JOIN a q ON o.seg_id = q.seg_id AND o.tid = q.tid AND q.b = 1),
    sc AS (SELECT z.*, CASE WHEN k0 IS NULL THEN -2 ELSE CASE WHEN pc0[2] = '=' THEN 6 ELSE 0 END + CASE WHEN pc1[2] = '=' THEN 4 ELSE 0 END - CASE WHEN k0 > 1 THEN 1 ELSE 0 END - CASE WHEN k1 IS NOT NULL AND qi0 <> pi1 + 1 THEN 1 ELSE 0 END END
      + CASE WHEN k1 IS NULL THEN -2 ELSE CASE WHEN qc1[1] = '=' THEN 2 ELSE 0 END + CASE WHEN qc0[2] = '=' THEN 4 ELSE 0 END + CASE WHEN qc1[2] = '=' THEN 4 ELSE 0 END - CASE WHEN k1 > 1 THEN 1 ELSE 0 END END AS score FROM z),
    f AS (SELECT sc.*, CASE WHEN k0 IS NULL OR k1 IS NULL THEN 10000 ELSE s1 - u.s + e2 - v.e END AS edge, len FROM sc JOIN seg USING (seg_id) LEFT JOIN x u ON u.tid = sc.tid AND u.i = pi0 LEFT JOIN x v ON v.tid = sc.tid AND v.i = qi1 JOIN (SELECT tid, sum(e - s + 1) AS len FROM x GROUP BY tid) g ON g.tid = sc.tid)
    SELECT seg_id, tid, score::INT AS score, edge::BIGINT AS from_edge FROM f QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY score DESC, edge, len, tid) = 1"""
)
def best_transcript(spark, d):
    return E.best_transcripts(_two_blocks(spark, d), _transcripts(spark, d)).select("seg_id", "tid", "score", "from_edge")


@query(_TWO + "SELECT seg_id, o.tid, round(sum(greatest(0, least(be, e) - greatest(bs, s) + 1)) / max(len), 9) AS coverage FROM ok o JOIN bl USING (seg_id) JOIN x ON x.tid = o.tid JOIN (SELECT tid, sum(e - s + 1) AS len FROM x GROUP BY tid) l ON l.tid = o.tid GROUP BY seg_id, o.tid")
def exon_coverage(spark, d):
    rows = E.covered_bases(_two_blocks(spark, d), _transcripts(spark, d))
    # Rounded half up in whole numbers: round() of a double goes through its decimal text in every row.
    return rows.select("seg_id", "tid", (F.expr("(2000000000 * covered + length) div (2 * length)") / 1e9).alias("coverage"))


@query(_TWO + "SELECT s.target, tid, e1 AS pos1, s2 AS pos2, count(*) AS depth FROM ok o JOIN seg s USING (seg_id) JOIN (SELECT seg_id, tid, max(i) AS i1 FROM m WHERE b = 0 GROUP BY ALL) p USING (seg_id, tid) JOIN (SELECT seg_id, tid, min(i) AS i2 FROM m WHERE b = 1 GROUP BY ALL) q USING (seg_id, tid) WHERE i1 <> i2 GROUP BY ALL")
def junction_depth(spark, d):
    return E.junction_depths(_two_blocks(spark, d), _transcripts(spark, d))


_JUNC = """SELECT l_orderkey * 100 + rn AS j, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, 1000 + l_partkey % 40 AS block1_end, 1000 + l_partkey % 40 + 1 + l_suppkey % 60 AS block2_start,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 3 END AS exon1, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN '==' WHEN l_partkey % 5 = 0 THEN '=>' ELSE '=<' END AS code1,
    CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE l_partkey % 3 + l_suppkey % 3 END AS exon2, CASE WHEN l_partkey % 11 = 0 THEN '<=' WHEN l_suppkey % 2 = 0 THEN '==' ELSE '>=' END AS code2,
    1010 AS exon1_end, 1030 AS exon2_start, l_partkey % 200 AS skipped, l_suppkey % 10 = 0 AS known, l_partkey % 4 <> 1 AS motif FROM items"""


@query(
    ctes("items")
    + f""", u AS ({_JUNC}), v AS (SELECT * FROM u WHERE NOT known),
    r AS (SELECT j, CASE WHEN block2_start - block1_end - 1 > 20 AND motif THEN 'novel_intron' ELSE 'del' END AS event, block2_start - block1_end - 1 AS size FROM v WHERE code1 IS NULL AND exon2 = 0 AND code2 = '<=' AND block2_start - block1_end - 1 > 0
    UNION ALL SELECT j, 'skipped_exon', skipped FROM v WHERE code1 IS NOT NULL AND exon2 > exon1 + 1
    UNION ALL SELECT j, CASE WHEN block2_start - block1_end - 1 > 20 AND motif THEN 'novel_intron' WHEN block2_start - block1_end - 1 > 0 THEN 'del' ELSE 'ins' END, block2_start - block1_end - 1 FROM v WHERE code1 IS NOT NULL AND exon1 = exon2 AND code1[2] = '<' AND code2[1] = '>' AND block2_start - block1_end - 1 >= 0
    UNION ALL SELECT j, CASE WHEN strand = '+' THEN 'novel_acceptor' ELSE 'novel_donor' END, abs(block2_start - 1030) FROM v WHERE code1 IS NOT NULL AND code2[1] <> '=' AND motif
    UNION ALL SELECT j, CASE WHEN strand = '+' THEN 'novel_donor' ELSE 'novel_acceptor' END, abs(block1_end - 1010) FROM v WHERE code1 IS NOT NULL AND code1[2] <> '=' AND motif)
    SELECT j, event, size FROM r WHERE event NOT IN ('ins', 'del')"""
)
def splice_classify(spark, d):
    rows = spark.sql(_JUNC.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items"))
    return P.classify(rows).select("j", "event", "size")


@query(
    ctes("sequences")
    + """, s AS (SELECT name, k, substr(seq, k, 2) AS d, substr(seq, k + 27, 2) AS a, CASE WHEN (name::BIGINT + k) % 2 = 0 THEN '+' ELSE '-' END AS st FROM (SELECT *, unnest(range(3, length(seq) - 29, 30)) AS k FROM sequences WHERE length(seq) > 40)),
    o AS (SELECT name, k, CASE WHEN st = '-' THEN translate(reverse(d), 'ACGT', 'TGCA') ELSE d END AS d, CASE WHEN st = '-' THEN translate(reverse(a), 'ACGT', 'TGCA') ELSE a END AS a FROM s),
    n AS (SELECT *, (d[1] <> 'G')::INT + (d[2] <> 'T')::INT AS dd, (a[1] <> 'A')::INT + (a[2] <> 'G')::INT AS da FROM o)
    SELECT name, k, CASE WHEN dd <= 1 AND da <= 1 AND dd + da <= 1 THEN d || a END AS motif FROM n"""
)
def splice_motif(spark, d):
    rows = Q.pieces(spark_view(spark, d, "sequences").where("length(seq) > 40"), 3, F.length("seq") - 30, 30, 29, ["name"])
    strand = F.when((F.col("name").cast("bigint") + F.col("k")) % 2 == 0, "+").otherwise("-")
    return rows.select("name", "k", P.motif_of(F.left("piece", F.lit(2)), F.right("piece", F.lit(2)), strand, F.lit(27))["motif"].alias("motif"))


_LINKS = "SELECT l_orderkey * 100 + rn AS event_id, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_orderkey AS STRING) END AS link_id, CAST(l_quantity AS INT) % 12 AS spanning FROM items"


@query(ctes("items") + f", e AS ({_LINKS}) SELECT * FROM e WHERE spanning >= 4 AND (link_id IS NULL OR link_id NOT IN (SELECT link_id FROM e WHERE spanning < 4 AND link_id IS NOT NULL))")
def splice_link_cascade(spark, d):
    return P.supported(spark.sql(_LINKS.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items")))


@query(ctes("items") + ", s AS (SELECT l_orderkey * 100 + rn AS event_id, l_partkey % 50 AS size FROM items) SELECT event_id, size % 3 = 0 AS in_frame FROM s")
def frame_by_size(spark, d):
    return spark_view(spark, d, "items").select((F.col("l_orderkey") * 100 + F.col("rn")).alias("event_id"), P.frame_by_size(F.col("l_partkey") % 50).alias("in_frame"))


@query(
    _PAIRS
    + ", g AS (SELECT *, CASE WHEN adj_id % 2 = 0 THEN '+' ELSE '-' END AS u, CASE WHEN adj_id % 3 = 0 THEN '+' ELSE '-' END AS v FROM merged), h AS (SELECT adj_id, (u = '+') = (orient1 = 'L') AS f1, (v = '+') = (orient2 = 'L') AS f2 FROM g) SELECT adj_id, CASE WHEN f1 AND NOT f2 THEN 1 WHEN f2 AND NOT f1 THEN 2 END AS upstream FROM h"
)
def fusion_sense(spark, d):
    strand = lambda k: F.when(F.col("adj_id") % k == 0, "+").otherwise("-")
    return _merged(spark, d).select("adj_id", U.sense_by_genome(strand(2), F.col("orient1"), strand(3), F.col("orient2")).alias("upstream"))


_FUSIONS = """SELECT a.gene || '-' || b.gene AS event_id, 1 + CAST(length(a.gene) % 2 AS INT) AS upstream, a.chrom AS chrom1, b.chrom AS chrom2, a.strand AS strand1, b.strand AS strand2, a.gene AS gene1, b.gene AS gene2,
    a.start AS start1, a.stop AS end1, b.start AS start2, b.stop AS end2 FROM genes a JOIN genes b ON a.k + 21 = b.k OR a.k + 3 = b.k OR a.k + 6 = b.k"""


@query(
    ctes("gene_rows")
    + f""", genes AS (SELECT gene, chrom, strand, start, "end" AS stop, coding, substr(gene, 2)::BIGINT AS k FROM gene_rows), f AS ({_FUSIONS}),
    o AS (SELECT *, CASE WHEN upstream = 1 THEN start1 ELSE start2 END AS us, CASE WHEN upstream = 1 THEN start2 ELSE start1 END AS ds, CASE WHEN upstream = 1 THEN end1 ELSE end2 END AS ue, CASE WHEN upstream = 1 THEN end2 ELSE end1 END AS de,
      CASE WHEN strand1 = '+' THEN start1 < start2 ELSE end1 <= end2 END AS fl FROM f),
    q AS (SELECT *, chrom1 = chrom2 AND strand1 = strand2 AND CASE WHEN strand1 = '+' THEN us <= ds ELSE de <= ue END AS able, CASE WHEN fl THEN end1 ELSE end2 END + 1 AS low, CASE WHEN fl THEN start2 ELSE start1 END - 1 AS high FROM o)
    SELECT event_id, able AND NOT EXISTS (SELECT 1 FROM genes g WHERE low < high AND g.chrom = chrom1 AND g.strand = strand1 AND coding AND g.start > low AND g.stop < high AND g.gene <> gene1 AND g.gene <> gene2) AS read_through FROM q"""
)
def read_through(spark, d):
    genes = spark_view(spark, d, "gene_rows")
    named = genes.select("gene", "chrom", "strand", "start", F.col("end").alias("stop"), F.expr("cast(substr(gene, 2) as bigint)").alias("k"))
    # A join on three offsets, as an equi-join on each.
    side = named.select(*[F.col(c).alias(f"b_{c}") for c in named.columns])
    rows = named.withColumn("other", F.explode(F.array(*[F.col("k") + n for n in (21, 3, 6)]))).join(side, F.col("other") == F.col("b_k"))
    c = F.col
    fusions = rows.select(F.concat_ws("-", "gene", "b_gene").alias("event_id"), (1 + F.length("gene") % 2).cast("int").alias("upstream"), c("chrom").alias("chrom1"), c("b_chrom").alias("chrom2"), c("strand").alias("strand1"), c("b_strand").alias("strand2"), c("gene").alias("gene1"), c("b_gene").alias("gene2"), c("start").alias("start1"), c("stop").alias("end1"), c("b_start").alias("start2"), c("b_stop").alias("end2"))
    return U.read_throughs(fusions, genes).select("event_id", "read_through")


@query(
    _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, g AS (SELECT query, rearrangement AS event, seg1 AS event_id, chrom1, break1, chrom2, break2 FROM classified), t AS (SELECT query, event, event_id, chrom1, break1 + event_id % 120 AS break1, chrom2, break2 FROM g WHERE event_id % 3 <> 0),
    c AS MATERIALIZED (SELECT g.event_id AS g, t.event_id AS t, row_number() OVER (ORDER BY t.query, t.event <> g.event, abs(t.break1 - g.break1) + abs(t.break2 - g.break2), t.event_id, g.event_id) AS k FROM t JOIN g ON g.query = t.query
      WHERE t.chrom1 = g.chrom1 AND t.chrom2 = g.chrom2 AND abs(t.break1 - g.break1) <= 100 AND abs(t.break2 - g.break2) <= 100),
    r AS (SELECT g, t, k, false AS taken FROM c UNION ALL SELECT g, t, k, taken FROM (
      WITH live AS (SELECT g, t, k FROM r WHERE NOT taken), low_g AS (SELECT g, min(k) AS m FROM live GROUP BY g), low_t AS (SELECT t, min(k) AS m FROM live GROUP BY t),
      ok AS (SELECT l.* FROM live l JOIN low_g a ON a.g = l.g AND a.m = l.k JOIN low_t b ON b.t = l.t AND b.m = l.k)
      SELECT g, t, k, true AS taken FROM ok UNION ALL SELECT g, t, k, false FROM live WHERE g NOT IN (SELECT g FROM ok) AND t NOT IN (SELECT t FROM ok))),
    b AS (SELECT g, t FROM r WHERE taken)
    SELECT t.*, CASE WHEN event_id IN (SELECT t FROM b) THEN 'both' ELSE 'transcripts' END AS found_in FROM t UNION ALL SELECT g.*, 'genome' FROM g WHERE event_id NOT IN (SELECT g FROM b)"""
)
def combine_events(spark, d):
    rows = _classified(spark, d).select("query", F.col("rearrangement").alias("event"), F.col("seg1").alias("event_id"), "chrom1", "break1", "chrom2", "break2")
    moved = rows.where("event_id % 3 <> 0").withColumns({"break1": F.col("break1") + F.col("event_id") % 120, "event_id": F.col("event_id")})
    return U.combine(rows, moved)


_MATES = "SELECT 'r' || CAST(l_orderkey AS STRING) AS name, rn AS mate, 't' || CAST(l_partkey % 40 AS STRING) AS target FROM items WHERE rn <= 2"


@query(ctes("items") + f", r AS ({_MATES}), g AS (SELECT name, mate, 'g' || (substr(target, 2)::BIGINT % 20) AS gene FROM r) SELECT least(a.gene, b.gene) AS gene1, greatest(a.gene, b.gene) AS gene2, count(DISTINCT a.name) AS pairs FROM g a JOIN g b ON a.name = b.name AND a.mate = 1 AND b.mate = 2 AND a.gene <> b.gene GROUP BY 1, 2 HAVING count(DISTINCT a.name) >= 4")
def discordant_pairs(spark, d):
    reads = spark.sql(_MATES.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items"))
    genes = reads.select("target").distinct().withColumn("gene", F.concat(F.lit("g"), F.substr("target", F.lit(2)).cast("bigint") % 20))
    return H.discordant_pairs(reads, genes)


@query(ctes("sequences") + ", s AS (SELECT name, length(seq) AS n FROM sequences) SELECT name, n FROM s WHERE n >= 500")
def filter_fasta(spark, d):
    return spark_view(spark, d, "sequences").select("name", F.length("seq").cast("bigint").alias("n")).where("n >= 500")


#: SQL for the amino acids of s from a frame on.
_AMINO = "array_to_string(list_transform(regexp_extract_all(substr(s, frame + 1), '...'), lambda c: CASE WHEN instr('TCAG', c[1]) * instr('TCAG', c[2]) * instr('TCAG', c[3]) > 0 THEN '" + Q.AMINO_ACIDS + "'[16 * instr('TCAG', c[1]) + 4 * instr('TCAG', c[2]) + instr('TCAG', c[3]) - 20] ELSE 'X' END), '')"


@query(
    ctes("sequences")
    + f""", strands AS (SELECT name, '+' AS strand, seq AS s FROM sequences UNION ALL SELECT name, '-', translate(reverse(seq), 'ACGT', 'TGCA') FROM sequences),
    f AS (SELECT name, strand, frame, {_AMINO} AS aa FROM strands, range(3) t(frame)),
    p AS (SELECT name, strand, frame, unnest(string_split(aa, '*')) AS part FROM f), g AS (SELECT * FROM p WHERE length(part) >= 10)
    SELECT name, coalesce(n, 0)::INT AS n, longest FROM sequences LEFT JOIN (SELECT name, count(*) AS n, first(part ORDER BY length(part) DESC, strand, frame, part) AS longest FROM g GROUP BY name) USING (name)"""
)
def open_reading_frames(spark, d):
    return U.open_reading_frames(spark_view(spark, d, "sequences"), 10)


@query(
    ctes("sequences")
    + f""", m AS (SELECT name, seq, length(seq) // 2 AS mid FROM sequences), x AS (SELECT name, seq, length(seq) AS n, mid AS cb1, mid + 1 AS cb2, left(seq, mid + 30) AS cds5, substr(seq, greatest(mid - 30, 1)) AS cds3 FROM m),
    y AS (SELECT name, 0 AS part, seq AS s FROM x UNION ALL SELECT name, 1, cds5 FROM x UNION ALL SELECT name, 2, cds3 FROM x),
    z AS (SELECT name, part, '+' AS strand, s FROM y UNION ALL SELECT name, part, '-', translate(reverse(s), 'ACGT', 'TGCA') FROM y),
    f AS MATERIALIZED (SELECT name, part, strand, frame, {_AMINO} AS aa FROM z, range(3) t(frame)),
    pr AS (SELECT name, part, string_agg(aa, '*') AS aa FROM f WHERE part > 0 GROUP BY name, part),
    c AS (SELECT f.name, aa, (CASE WHEN strand = '+' THEN cb1 ELSE n - cb2 + 1 END - frame) // 3 AS l, (CASE WHEN strand = '+' THEN cb2 ELSE n - cb1 + 1 END - frame + 1) // 3 AS r FROM f JOIN x USING (name) WHERE part = 0),
    w AS (SELECT name, aa[l - 4 : l] AS up, aa[r + 1 : r + 5] AS down FROM c WHERE l >= 5 AND r + 5 <= length(aa) AND NOT contains(aa[l - 4 : r + 5], '*')),
    g AS (SELECT DISTINCT w.name FROM w JOIN pr u ON u.name = w.name AND u.part = 1 JOIN pr d ON d.name = w.name AND d.part = 2 WHERE (contains(u.aa, up) AND contains(d.aa, down)) OR (contains(d.aa, up) AND contains(u.aa, down)))
    SELECT name, CASE WHEN seq <> '' AND cds5 <> '' AND cds3 <> '' THEN name IN (SELECT name FROM g) END AS in_frame FROM x"""
)
def frame_by_orf(spark, d):
    rows = spark_view(spark, d, "sequences")
    mid = (F.length("seq") / 2).cast("int")
    parts = rows.select("name", F.col("seq"), mid.alias("cb1"), (mid + 1).alias("cb2"), F.left("seq", mid + 30).alias("cds5"), F.substr("seq", F.greatest(mid - 30, F.lit(1))).alias("cds3"))
    return U.frames(parts).select("name", "in_frame")


_REF = "translate(substr(md5(CAST(adj_id AS STRING)), 1, 2), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _rendered(spark, d):
    rows = _merged(spark, d).where("rearrangement = 'trl'")
    m = F.get("members", F.lit(0))
    two = F.expr(_REF)
    return rows.withColumns({"contigs": F.array_join(F.transform("members", lambda x: x["contig"]), ","), "overlaps": m["cb1"] >= m["cb2"], "homol_seq": F.when(m["cb1"] >= m["cb2"], F.repeat(F.lit("A"), (m["cb1"] - m["cb2"] + 1).cast("int"))), "ref1": F.left(two, F.lit(1)), "ref2": F.right(two, F.lit(1)), "novel_seq": F.when(F.col("adj_id") % 4 == 0, "ACC"), "strand1": F.lit("+"), "strand2": F.when(F.col("adj_id") % 2 == 0, "+").otherwise("-"), "spanning": (F.col("adj_id") % 9).cast("int"), "flanking": F.lit(0)})


@query(
    _PAIRS
    + f""", b0 AS (SELECT *, regexp_replace(members, ':[^,]*', '', 'g') AS contigs, split_part(split_part(members, ',', 1), ':', 2) AS cb, {_REF} AS two FROM merged WHERE rearrangement = 'trl'),
    b1 AS (SELECT *, split_part(cb, '-', 1)::BIGINT - split_part(cb, '-', 2)::BIGINT + 1 AS n, two[1] AS ref1, two[2] AS ref2, CASE WHEN adj_id % 4 = 0 THEN 'ACC' ELSE '' END AS i1, CASE WHEN adj_id % 4 = 0 THEN CASE WHEN adj_id % 2 = 0 THEN 'ACC' ELSE 'GGT' END ELSE '' END AS i2 FROM b0),
    b2 AS (SELECT *, CASE WHEN n > 0 THEN n ELSE 0 END AS h, substr(chrom1, 4) AS c1, substr(chrom2, 4) AS c2, CASE WHEN n > 0 THEN ';CIPOS=0,' || n || ';HOMLEN=' || n || ';HOMSEQ=' || repeat('A', n) ELSE '' END || ';BKPTID=' || contigs || ';SPANNING_READS=' || adj_id % 9 || ';FLANKING_PAIRS=0' AS tail FROM b1)
    SELECT c1 AS chrom, break1 - h AS pos, adj_id || 'a' AS id, ref1 AS ref, CASE orient1 || orient2 WHEN 'LL' THEN ref1 || i1 || ']' || c2 || ':' || (break2 + h) || ']' WHEN 'LR' THEN ref1 || i1 || '[' || c2 || ':' || (break2 + h) || '[' WHEN 'RL' THEN ']' || c2 || ':' || (break2 + h) || ']' || i1 || ref1 ELSE '[' || c2 || ':' || (break2 + h) || '[' || i1 || ref1 END AS alt, 'SVTYPE=BND;EVENTTYPE=TRL;MATEID=' || adj_id || 'b' || tail AS info FROM b2
    UNION ALL SELECT c2, break2, adj_id || 'b', ref2, CASE orient1 || orient2 WHEN 'LL' THEN ref2 || i2 || ']' || c1 || ':' || break1 || ']' WHEN 'LR' THEN ']' || c1 || ':' || break1 || ']' || i2 || ref2 WHEN 'RL' THEN ref2 || i2 || '[' || c1 || ':' || break1 || '[' ELSE '[' || c1 || ':' || break1 || '[' || i2 || ref2 END, 'SVTYPE=BND;EVENTTYPE=TRL;MATEID=' || adj_id || 'a' || tail FROM b2"""
)
def vcf_breakends(spark, d):
    return vcf.breakends(_rendered(spark, d))


@query(
    _PAIRS
    + f""", s AS (SELECT *, regexp_replace(members, ':[^,]*', '', 'g') AS contigs, CASE WHEN rearrangement = 'del' THEN break2 - break1 - 1 ELSE break2 - break1 + 1 END AS size, {_REF} AS two FROM merged WHERE rearrangement IN ('del', 'dup', 'inv'))
    SELECT substr(chrom1, 4) AS chrom, break1 AS pos, adj_id::VARCHAR AS id, two[1] AS ref, CASE WHEN rearrangement = 'dup' THEN '<DUP:TANDEM>' ELSE '<' || upper(rearrangement) || '>' END AS alt,
    'SVTYPE=' || upper(rearrangement) || ';END=' || (break1 + size) || ';SVLEN=' || CASE WHEN rearrangement = 'del' THEN -size ELSE size END || ';BKPTID=' || contigs || ';SPANNING_READS=' || adj_id % 9 || CASE WHEN rearrangement = 'dup' THEN ';REPEAT_SEQ=CAG;REPEAT_NUM=2;REPEAT_NUM_CHANGE=1>3' ELSE '' END AS info FROM s"""
)
def vcf_symbolic(spark, d):
    c = F.col
    rows = _merged(spark, d).where("rearrangement in ('del', 'dup', 'inv')")
    n = A.size(c("rearrangement"), c("break1"), c("break2"), F.lit(None).cast("string"), F.lit(False))
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"contigs": F.array_join(F.transform("members", lambda x: x["contig"]), ","), "size": n, "ref1": F.left(F.expr(_REF), F.lit(1)), "homol_seq": none, "overlaps": F.lit(False), "spanning": (c("adj_id") % 9).cast("int"), "flanking": F.lit(None).cast("int"), "repeat_seq": F.lit("CAG"), "repeat_num": F.lit(2), "repeat_change": F.lit("1>3")})
    return vcf.symbolic(rows)


@query(_PAIRS + r"""SELECT chrom1 || chr(9) || (break1 - 1) || chr(9) || break1 || chr(9) || chrom2 || chr(9) || (break2 - 1) || chr(9) || break2 || chr(9) || adj_id || chr(9) || '.' || chr(9) || '+' || chr(9) || '+' || chr(9) || orient1 || chr(9) || orient2 || chr(9) || rearrangement || chr(9)
    || coalesce((CASE WHEN rearrangement = 'del' THEN break2 - break1 - 1 WHEN rearrangement NOT IN ('trl', 'ins') THEN break2 - break1 + 1 END)::VARCHAR, 'NA') || repeat(chr(9) || '-', 13) AS value FROM merged""")
def bedpe_render(spark, d):
    c = F.col
    rows = _merged(spark, d)
    return T.genome_bedpe(rows.withColumn("size", A.size(c("rearrangement"), c("break1"), c("break2"), F.lit(None).cast("string"), F.lit(False))))


@query(ctes("segments") + ", g AS (SELECT target, tstart, tend, coalesce(max(tend) OVER (PARTITION BY target ORDER BY tstart, tend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), tstart - 1) AS r FROM segments) SELECT target, sum(greatest(0, tend - greatest(tstart - 1, r)))::BIGINT AS covered FROM g GROUP BY target")
def target_coverage(spark, d):
    return I.union_length(_segments(spark, d), ["target"], "tstart", "tend").select("target", "covered")


@query(ctes("segments") + "SELECT seg_id, target, row_number() OVER (ORDER BY substr(target, 4)::INT, tstart, seg_id) AS place FROM segments")
def chromosome_order(spark, d):
    rows = _segments(spark, d).withColumn("k", coords.chrom_key(F.col("target")))
    return A.number(rows.select("seg_id", "target", "k", "tstart"), ["k", "tstart", "seg_id"], "place").select("seg_id", "target", "place")


# Transcripts at breaks, sub-sequences, agreement of mappings, equal events of one contig, and sites of splicing.
@query(
    _TWO
    + """, s2 AS (SELECT *, CASE WHEN seg_id % 2 = 0 THEN 'L' ELSE 'R' END AS orient, CASE WHEN seg_id % 2 = 0 THEN e2 ELSE s1 END AS brk FROM seg),
    tx AS (SELECT tid, strand, count(*) AS n, sum("end" - start + 1)::BIGINT AS len, min(start) AS first, max("end") AS last, bool_or(coding) AS coding FROM exon_rows GROUP BY tid, strand),
    u AS (SELECT *, CASE WHEN coding THEN CASE WHEN strand = '+' THEN first + 10 ELSE last - 10 END END AS cs, CASE WHEN coding THEN CASE WHEN strand = '+' THEN last - 10 ELSE first + 10 END END AS ce FROM tx),
    a AS (SELECT seg_id, tid, b, count(*) AS k, arg_min(code, i) AS c0, arg_max(code, i) AS c1 FROM m JOIN ok USING (seg_id, tid) GROUP BY seg_id, tid, b),
    z AS (SELECT o.seg_id, o.tid, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 1 AND c0 = '==') AS n2, max(c0) FILTER (b = 0) AS first_code, max(c1) FILTER (b = 1) AS last_code FROM ok o LEFT JOIN a USING (seg_id, tid) GROUP BY o.seg_id, o.tid),
    q AS (SELECT z.*, coalesce(CASE WHEN orient = 'L' THEN last_code[2] = '=' ELSE first_code[1] = '=' END, false) AS bound, u.*  EXCLUDE (tid),
      coalesce(CASE WHEN strand = '+' THEN brk BETWEEN first AND cs - 1 OR brk BETWEEN ce + 4 AND last ELSE brk BETWEEN cs + 1 AND last OR brk BETWEEN first AND ce - 4 END, false) AS in_utr FROM z JOIN s2 USING (seg_id) JOIN u USING (tid))
    SELECT seg_id, tid, bound AS at_bound, in_utr, n1::INT AS n_single, n2::INT AS n_exact FROM q QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY bound DESC, coding DESC, in_utr, n1 DESC, n2 DESC, n DESC, len DESC, tid) = 1"""
)
def breakpoint_transcript(spark, d):
    even = F.col("seg_id") % 2 == 0
    segments = _two_blocks(spark, d).withColumns({"orient": F.when(even, "L").otherwise("R"), "breaks": F.array(F.when(even, F.col("tend")).otherwise(F.col("tstart")))})
    return E.best_at_breaks(segments, _transcripts(spark, d)).select("seg_id", "tid", "at_bound", "in_utr", "n_single", "n_exact")


_BROKEN = """SELECT CAST(l_orderkey AS BIGINT) AS event_id, CASE WHEN l_orderkey % 5 = 0 THEN 'skipped_exon' WHEN l_orderkey % 5 = 1 THEN 'dup' WHEN l_orderkey % 5 = 2 THEN 'repeat_expansion' ELSE 'fusion' END AS event, CAST(l_partkey % 997 AS STRING) AS query, rn AS nth,
    CAST(20 + l_suppkey % 300 AS BIGINT) AS cb1, CAST(20 + l_suppkey % 300 + l_linenumber - 3 AS BIGINT) AS cb2 FROM items"""
_SUB = (
    ctes("items", "sequences")
    + f""", ev AS ({_BROKEN}), c AS (SELECT ev.*, seq, least(cb1, cb2) AS lo, greatest(cb1, cb2) AS hi FROM ev JOIN sequences ON name = query WHERE event NOT IN ('skipped_exon', 'repeat_expansion')),
    pick AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY least(lo, length(seq) - hi) DESC, nth) = 1),
    sub AS (SELECT event_id, event, query, 0 AS piece, left(seq, lo) AS seq FROM pick UNION ALL SELECT event_id, event, query, 1, substr(seq, hi) FROM pick)"""
)


def _sub_sequences(spark, d):
    return U.sub_sequences(spark.sql(_BROKEN.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items")), spark_view(spark, d, "sequences"))


@query(_SUB + "SELECT event_id, query, piece, md5(seq) AS seq, length(seq)::INT AS length FROM sub")
def sub_sequences(spark, d):
    return _sub_sequences(spark, d).select("event_id", "query", "piece", F.md5("seq").alias("seq"), "length")


@query(
    _SUB
    + """, al AS (SELECT event_id, event, piece, length(seq) AS length, unnest(range(length(seq) % 4)) AS hit FROM sub),
    good AS (SELECT event_id, piece FROM al WHERE event = 'fusion' AND (event_id + hit) % 3 <> 0 AND hit <> 2 AND length <> 0 GROUP BY event_id, piece HAVING count(*) > 1)
    SELECT DISTINCT event_id FROM good"""
)
def multimapped_events(spark, d):
    hits = _sub_sequences(spark, d).withColumn("hit", F.explode(F.expr("if(length % 4 > 0, sequence(0, length % 4 - 1), array())")))
    rows = hits.select("event_id", "event", "piece", "length", F.when(F.col("hit") == 2, "chrUn_1").otherwise("chr1").alias("target"), F.col("length").alias("matched"), F.when((F.col("event_id") + F.col("hit")) % 3 == 0, 1).otherwise(0).alias("nm"))
    return U.multimapped(rows)


_AGREE = "SELECT CAST(l_orderkey AS STRING) AS query, l_orderkey * 100 + rn AS event_id, 'g' || CAST(l_partkey % 6 AS STRING) AS gene1, 'g' || CAST(l_suppkey % 6 AS STRING) AS gene2 FROM items"
_OTHER = "SELECT CAST(o_orderkey AS STRING) AS query, 'g' || CAST(o_custkey % 6 AS STRING) AS gene, o_orderstatus = 'F' AS whole FROM orders UNION ALL SELECT CAST(o_orderkey AS STRING), 'g' || CAST((o_custkey + 1) % 6 AS STRING), true FROM orders WHERE o_custkey % 4 = 0"


@query(
    ctes("items")
    + f""", ev AS ({_AGREE}), o AS ({_OTHER}), x AS (SELECT query, list_distinct(list(gene)) AS genes, count(*) = 1 AND bool_and(whole) AS fully FROM o GROUP BY query)
    SELECT event_id FROM ev LEFT JOIN x USING (query) WHERE NOT coalesce(gene1 <> gene2 AND ((len(genes) = 1 AND fully) OR NOT list_has_any(genes, [gene1, gene2])), false)"""
)
def mapping_agreement(spark, d):
    events = spark.sql(_AGREE.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items")).withColumn("genes", F.array("gene1", "gene2"))
    other = spark.sql(_OTHER.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    return U.agreeing(events, U.mapping_states(other)).select("event_id")


_TWICE = "SELECT CAST(l_orderkey AS STRING) AS query, rn, CASE WHEN l_partkey % 2 = 0 THEN 'del' ELSE 'dup' END AS rearrangement, 'chr1' AS chrom1, CAST(l_suppkey % 2 AS BIGINT) AS break1, 'L' AS orient1, 'chr1' AS chrom2, CAST(500 AS BIGINT) AS break2, 'R' AS orient2, CAST(l_linenumber % 3 AS BIGINT) AS cb1, CAST(l_linenumber % 3 + 9 AS BIGINT) AS cb2 FROM items"


@query(
    ctes("items")
    + f""", ev AS ({_TWICE}), n AS (SELECT *, lag([rearrangement, break1::VARCHAR]) OVER w = [rearrangement, break1::VARCHAR] AND lag(cb1) OVER w <> cb1 AS a, lead([rearrangement, break1::VARCHAR]) OVER w = [rearrangement, break1::VARCHAR] AND lead(cb1) OVER w <> cb1 AS b
      FROM ev WINDOW w AS (PARTITION BY query ORDER BY cb1, cb2, rearrangement, break1))
    SELECT query, rearrangement, break1, cb1, count(*) AS n, bool_or(coalesce(a, false) OR coalesce(b, false)) AS twice FROM n GROUP BY ALL"""
)
def same_event_two_breaks(spark, d):
    rows = A.same_event_twice(spark.sql(_TWICE.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items")))
    return rows.groupBy("query", "rearrangement", "break1", "cb1").agg(F.count("*").alias("n"), F.bool_or("twice").alias("twice"))


@query(
    _TX.replace("count(*) AS n FROM", "count(*) AS n, list({'s': start, 'e': \"end\"} ORDER BY start, \"end\") AS x FROM")
    + """, p AS (SELECT tid, strand, x, n, unnest(range(1, n)) AS a FROM t WHERE n > 1), q AS (SELECT *, a + 1 + tid::BIGINT % 2 AS b FROM p),
    r AS (SELECT tid, strand, x, a, b, CASE WHEN strand = '-' THEN n - (b - 1) + 1 ELSE a + 1 END AS mid, CASE WHEN strand = '-' THEN n - b + 1 ELSE a END AS lo, CASE WHEN strand = '-' THEN n - a + 1 ELSE b END AS hi FROM q WHERE b <= n)
    SELECT tid, a::INT AS exon1, b::INT AS exon2, CASE WHEN b > a + 1 THEN (x[mid].s - 2) || ',' || (x[mid].s - 1) || ',' || (x[mid].e + 1) || ',' || (x[mid].e + 2) END AS skipped,
      (x[lo].e + 1) || ',' || (x[lo].e + 2) || ',' || (x[hi].s - 2) || ',' || (x[hi].s - 1) AS novel FROM r"""
)
def splice_site_positions(spark, d):
    c = F.col
    rows = _transcripts(spark, d).where("size(exons) > 1").withColumn("exon1", F.explode(F.expr("sequence(1, size(exons) - 1)")))
    rows = rows.withColumn("exon2", (c("exon1") + 1 + F.pmod(c("tid").cast("bigint"), F.lit(2))).cast("int")).where("exon2 <= size(exons)")
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    args = c("exons"), c("strand"), c("exon1"), c("exon2")
    return rows.select("tid", "exon1", "exon2", text(P.skipped_exon_sites(*args)).alias("skipped"), text(P.novel_site_positions(*args)).alias("novel"))


@query(
    ctes("sequences")
    + """, s AS (SELECT name, k, substr(seq, k, 30) AS g, translate(substr(seq, k, 30), 'G', 'T') AS c, CASE WHEN (name::BIGINT + k) % 2 = 0 THEN '+' ELSE '-' END AS st FROM (SELECT *, unnest(range(1, length(seq) - 28, 30)) AS k FROM sequences WHERE length(seq) >= 30)),
    e AS (SELECT *, left(g, 2) AS g1, right(g, 2) AS g2, left(c, 2) AS c1, right(c, 2) AS c2 FROM s),
    n AS (SELECT *, (g1[1] <> c1[1])::INT + (g1[2] <> c1[2])::INT AS n1, (g2[1] <> c2[1])::INT + (g2[2] <> c2[2])::INT AS n2 FROM e),
    m AS (SELECT *, CASE WHEN st = '-' THEN translate(reverse(c1), 'ACGT', 'TGCA') ELSE c1 END AS m1, CASE WHEN st = '-' THEN translate(reverse(c2), 'ACGT', 'TGCA') ELSE c2 END AS m2,
      CASE WHEN g1[1] <> c1[1] THEN 1 ELSE 2 END AS i1, CASE WHEN g2[1] <> c2[1] THEN 1 ELSE 2 END AS i2 FROM n WHERE n1 + n2 <= 1)
    SELECT name, k, m1 AS motif1, m2 AS motif2, CASE WHEN n1 = 1 THEN 'chr1:' || (k + i1 - 1) || g1[i1] || '>' || c1[i1] END AS variant1, CASE WHEN n2 = 1 THEN 'chr1:' || (k + 28 + i2 - 1) || g2[i2] || '>' || c2[i2] END AS variant2 FROM m"""
)
def retained_intron_motif(spark, d):
    rows = Q.pieces(spark_view(spark, d, "sequences"), 1, F.length("seq") - 29, 30, 30, ["name"])
    genome = F.col("piece")
    strand = F.when((F.col("name").cast("bigint") + F.col("k")) % 2 == 0, "+").otherwise("-")
    found = rows.select("name", "k", P.retained_intron_motif(F.lit("chr1"), F.col("k") - 1, F.col("k") + 30, F.translate(genome, "G", "T"), genome, strand).alias("m")).where("m is not null")
    return found.select("name", "k", F.col("m")[0]["motif"].alias("motif1"), F.col("m")[1]["motif"].alias("motif2"), F.col("m")[0]["variant"].alias("variant1"), F.col("m")[1]["variant"].alias("variant2"))


@query(
    ctes("exon_rows")
    + """, a AS (SELECT *, tid::BIGINT % 3 AS src FROM exon_rows), j AS (SELECT chrom, "end" AS start, lead(start) OVER (PARTITION BY tid ORDER BY row) AS stop, src FROM a),
    u AS (SELECT 'exon' AS kind, chrom, start, "end" AS stop, src FROM a UNION ALL SELECT 'junction', chrom, start, stop, src FROM j WHERE stop IS NOT NULL)
    SELECT kind, chrom, start, stop AS "end", string_agg(DISTINCT 's' || src, ',' ORDER BY 's' || src) AS sources FROM u GROUP BY kind, chrom, start, stop"""
)
def annotation_union(spark, d):
    rows = spark_view(spark, d, "exon_rows")
    parts = {f"s{n}": rows.where(F.col("tid").cast("bigint") % 3 == n) for n in range(3)}
    both = [E.annotated(parts, kind).select(F.lit(kind).alias("kind"), "chrom", "start", "end", F.array_join("sources", ",").alias("sources")) for kind in ("exon", "junction")]
    return both[0].union(both[1])


@query(
    ctes("segments")
    + """, m AS (SELECT query, query_len, seg_id, qstart, qend, coalesce(max(qend) OVER (PARTITION BY query ORDER BY qstart, qend, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM segments WHERE mapq % 3 > 0),
    g AS (SELECT query, reached + 1 AS start, qstart - 1 AS stop FROM m WHERE qstart > reached + 1 UNION ALL SELECT query, max(qend) + 1, max(query_len) FROM m GROUP BY query HAVING max(qend) < max(query_len))
    SELECT query, start, stop FROM g"""
)
def uncovered_spans(spark, d):
    rows = _segments(spark, d).where("mapq % 3 > 0").groupBy("query").agg(F.max("query_len").alias("n"), F.collect_list(F.struct(F.col("qstart").alias("start"), F.col("qend").alias("end"))).alias("spans"))
    return rows.select("query", F.explode(C.uncovered(F.col("spans"), F.lit(1), F.col("n"))).alias("g")).select("query", "g.start", F.col("g.end").alias("stop"))


@query(
    ctes("items")
    + f""", ev AS ({_AGREE}), o AS ({_OTHER}), u AS (SELECT query, gene FROM o UNION SELECT query, gene1 FROM ev UNION SELECT query, gene2 FROM ev)
    SELECT query, string_agg(gene, ',' ORDER BY gene) AS genes FROM u GROUP BY query"""
)
def mapped_genes(spark, d):
    events = spark.sql(_AGREE.replace("FROM items", "FROM {items}"), items=spark_view(spark, d, "items"))
    other = spark.sql(_OTHER.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    return U.genes_of(other, events).select("query", F.array_join("genes", ",").alias("genes"))


@query(ctes("segments", "sequences") + "SELECT seg_id, substr(seq, qstart, qend - qstart + 1) AS aligned FROM segments JOIN sequences ON name = query")
def aligned_sequences(spark, d):
    rows = _segments(spark, d).join(spark_view(spark, d, "sequences").withColumnRenamed("name", "query"), "query")
    return rows.select("seg_id", C.aligned_seq(F.col("seq"), F.col("qstart"), F.col("qend")).alias("aligned"))
