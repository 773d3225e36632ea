"""Views that turn the driver's tables into inputs of the operators, so that each operator can run on them and be checked by SQL.

The operators do not know about these views. Each view is SQL that Spark and DuckDB both run; ``spark_view`` runs it on Spark,
``ctes`` gives it as common table expressions for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Numbered line items: (l_orderkey, l_linenumber) is not unique, these four columns are.
VIEWS = {
    "items": """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem""",
    "segments": """SELECT l_orderkey * 100 + rn AS seg_id, CAST(l_orderkey AS STRING) AS query, CAST(n * 100 + 5 AS INT) AS query_len,
        CASE WHEN l_partkey % 4 = 0 THEN 'chr1' ELSE 'chr' || CAST(l_suppkey % 3 + 1 AS STRING) END AS target,
        CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, (rn - 1) * 100 + 1 + l_partkey % 5 AS qstart, rn * 100 + l_suppkey % 5 AS qend,
        CASE WHEN l_partkey % 4 = 0 THEN (l_orderkey % 1000) * 10000 + rn * 100 - (rn * 100 + l_suppkey % 5) % 5 ELSE CAST(floor(l_extendedprice) AS BIGINT) + 1 END AS tstart,
        CASE WHEN l_partkey % 4 = 0 THEN (l_orderkey % 1000) * 10000 + rn * 100 - (rn * 100 + l_suppkey % 5) % 5 ELSE CAST(floor(l_extendedprice) AS BIGINT) + 1 END
          + (rn * 100 + l_suppkey % 5) - ((rn - 1) * 100 + 1 + l_partkey % 5) AS tend,
        l_linestatus = 'O' AS is_primary, CAST(l_quantity AS INT) AS nm, CAST(l_suppkey % 61 AS INT) AS mapq, rn FROM items""",
    "alternatives": """SELECT seg_id + 50 AS seg_id, query, query_len, CASE WHEN mapq % 5 = 0 THEN target ELSE 'chr' || CAST(mapq % 2 + 1 AS STRING) END AS target, qstart + nm % 4 AS qstart, qend - nm % 3 + mapq % 3 AS qend, tstart + 100000 * (nm - 20) AS tstart,
        CAST(mapq % 7 AS BIGINT) AS edits FROM segments WHERE mapq % 4 <> 0""",
    "members": """SELECT seg_id, query, query_len, target, qstart, qend, tstart, CAST(nm % 5 AS BIGINT) AS edits FROM segments WHERE query_len BETWEEN 200 AND 310""",
    "sequences": """SELECT CAST(doc_id AS STRING) AS name, upper(translate(LETTERS(text), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')) AS seq FROM documents""",
    "exon_rows": """SELECT CAST(l_orderkey AS STRING) AS tid, 'g' || CAST(l_orderkey % 500 AS STRING) AS gene, 'chr' || CAST(l_orderkey % 3 + 1 AS STRING) AS chrom,
        CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, rn AS row, (l_orderkey % 500) * 3000 + rn * 300 + l_partkey % 50 AS start,
        (l_orderkey % 500) * 3000 + rn * 300 + l_partkey % 50 + 60 + l_suppkey % 100 AS end, l_orderkey % 5 <> 0 AS coding, n FROM items""",
    "reads": """SELECT event_id AS seq_no, 'r' || CAST(event_id % 4000 AS STRING) AS name, 'c' || CAST(user_id % 20 AS STRING) AS contig, CAST(floor(value * 10) AS BIGINT) % 900 + 1 AS rstart,
        CAST(floor(value * 10) AS BIGINT) % 900 + 60 + event_id % 41 AS rend, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_type <> 'error' AS whole FROM events""",
    "spans": """SELECT DISTINCT 'c' || CAST(p_partkey % 20 AS STRING) AS contig, (p_partkey * 37) % 900 + 20 AS span1, (p_partkey * 37) % 900 + 20 + p_size % 7 AS span2 FROM part""",
    "gene_rows": """SELECT 'p' || CAST(p_partkey AS STRING) AS gene, 'chr' || CAST(p_partkey % 3 + 1 AS STRING) AS chrom, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
        p_partkey * 50 + 1 AS start, p_partkey * 50 + 400 + p_size * 5 AS end, p_size % 3 <> 0 AS coding FROM part""",
}
TABLES = ("lineitem", "documents", "events", "part", "orders", "customer", "supplier")


def _needs(name: str) -> list[str]:
    out: list[str] = []
    for other in VIEWS:
        if other != name and re.search(rf"\bFROM {other}\b", VIEWS[name]):
            out += [*_needs(other), other]
    return list(dict.fromkeys(out))


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``, or a table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"LETTERS\((\w+)\)", r"regexp_replace(lower(\1), '[^a-z]', '')", VIEWS[name])
    used = [t for t in (*VIEWS, *TABLES) if re.search(rf"\bFROM {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: spark_view(spark, sf_dir, t) for t in used})


def ctes(*names: str) -> str:
    """WITH clauses of views and what they need, for DuckDB; ends in a comma-free list."""
    order = list(dict.fromkeys(n for name in names for n in (*_needs(name), name)))
    body = [f'{n} AS ({re.sub(r"LETTERS[(]([a-z]+)[)]", r"regexp_replace(lower(\1), '[^a-z]', '', 'g')", VIEWS[n])})' for n in order]
    return "WITH " + ",\n".join(body).replace(" AS end,", ' AS "end",').replace(" AS end ", ' AS "end" ')
