"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, connected components.

A fingerprint has 64 bits. With ``blocks`` blocks and at most ``max_distance`` differing bits, at least
``blocks - max_distance`` blocks of two linked fingerprints are equal, so every linked pair meets under the key of one such
choice of blocks. Equal fingerprints are one class before that, and a key's members are compared inside one task, which
returns a spanning forest of the links (never all pairs). Keys with more than ``cell`` members are split into cells, and each
pair of cells is a group of its own, so no group holds more than about two cells.

Defined cases: a null text has no words, hence fingerprint zero, like an empty one; repeated rows each get a row; null ids
count as no id (a component of null ids only has a null component_id); very long texts count whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, remove, ship, written


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The signed 64-bit fingerprint of one text; ``shingle`` words make a shingle."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        parts = [joined[s:e] for s, e in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the signed form, text_hash tells texts of one id apart."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = pa.array([fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, text_hash long, fp long")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def _links_of(flat: np.ndarray, names: np.ndarray, offsets: np.ndarray, most: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links (by name) within each group: for small groups all at once by shifts, for larger ones a search that drops what it has
    reached."""
    left, right = [], []
    sizes = np.diff(offsets)
    group = np.repeat(np.arange(len(sizes)), sizes)
    keep = sizes[group] <= small
    values, owner, named = flat[keep], group[keep], names[keep]
    shift = 1
    while shift < len(values):
        same = owner[shift:] == owner[:-shift]
        if not same.any():
            break
        near = same & (_apart(values[:-shift], values[shift:]) <= most)
        left.append(named[:-shift][near])
        right.append(named[shift:][near])
        shift += 1
    for g in np.flatnonzero(sizes > small):
        order = np.argsort(names[offsets[g] : offsets[g + 1]])  # the same links whatever the order of arrival
        rest, ids = flat[offsets[g] : offsets[g + 1]][order], names[offsets[g] : offsets[g + 1]][order]
        while len(rest) > 1:
            frontier, rest, ids = [(rest[0], ids[0])], rest[1:], ids[1:]
            while frontier and len(rest):
                at, name = frontier.pop()
                near = _apart(rest, at) <= most
                if near.any():
                    left.append(np.full(int(near.sum()), name, ids.dtype))
                    right.append(ids[near])
                    frontier.extend(zip(rest[near], ids[near], strict=True))
                    rest, ids = rest[~near], ids[~near]
    none = np.zeros(0, names.dtype)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _block_keys(fp, blocks: int, equal: int):
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    starts = [sum(widths[:i]) for i in range(blocks)]
    parts = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, widths, strict=True)]
    return F.array(*[F.xxhash64(F.lit(n), *[parts[i] for i in chosen]) for n, chosen in enumerate(combinations(range(blocks), equal))])


def links(classes: DataFrame, max_distance: int = 4, blocks: int = 6, cell: int = 4096) -> DataFrame:
    """Distinct links (a, b), a < b, that span the components of the fingerprints in ``classes.fp``; each pair is at most
    ``max_distance`` bits apart."""
    if blocks <= max_distance:
        raise ValueError("there must be more blocks than differing bits")
    member = F.struct(F.col("fp").alias("bits"), "fp").alias("member")
    return grouped_links(classes.select(member, F.explode(_block_keys(F.col("fp"), blocks, blocks - max_distance)).alias("key")), max_distance, cell)


def grouped_links(keyed: DataFrame, most: int, cell: int = 4096) -> DataFrame:
    """Distinct links (a, b), a < b, between members (words of bits, then fp) of one ``key`` whose bits differ in at most ``most``
    places; they span what such links connect under a key."""
    ship(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            *words, names = (np.asarray(x) for x in lists.flatten().flatten())
            bits = np.stack(words, axis=1).view(np.uint64)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            x, y = _links_of(bits, names, offsets - offsets[0], most)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    # Keys of more than a cell are dealt into cells, and each pair of cells becomes a group.
    hot = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("key", F.ceil(F.col("n") / cell).cast("int").alias("cells")))
    cells = F.coalesce("cells", F.lit(1))
    own = F.pmod(F.xxhash64("member.fp"), cells).cast("int")
    dealt = keyed.join(hot, "key", "left").select("member", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("other"))
    at = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    groups = dealt.groupBy(at.alias("at")).agg(F.collect_list("member").alias("members")).where(F.size("members") > 1).select("members")
    return groups.mapInArrow(lean(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches.

    Each round takes the smallest label among a node's neighbours, for the node and for the node's own label too, and then the
    label of that label, until nothing changes; so chains end in few rounds as well. A round is a table in the shared folder, and the one before goes.
    """
    spark = edges.sparkSession
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    both = durable(edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*"))
    labels, path = written(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("dst"), "root"), "dst").groupBy("src").agg(F.min("root").alias("m"))
        near, near_path = written(labels.join(seen.withColumnRenamed("src", "node"), "node").select("node", F.col("root").alias("was"), "m"))
        lifted = near.groupBy(F.col("was").alias("node")).agg(F.min("m").alias("h"))
        near = near.join(lifted, "node", "left").select("node", "was", F.least("was", "m", "h").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new, new_path = written(near.join(jump, "via").select("node", "was", F.least("via", "far").alias("root")))
        done = new.where("was <> root").isEmpty()
        remove(spark, path)
        remove(spark, near_path)
        labels, path = new.select("node", "root"), new_path
        if done:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, blocks: int = 6) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, fp (signed), component_id (smallest id reachable over links)."""
    rows = durable(fingerprints(docs, id_col, text_col, shingle))
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(classes, max_distance, blocks))
    rooted = durable(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    ids = durable(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))  # so that a root of many can be split in the join
    named = durable(rooted.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without all but one row of each component: the smallest (id, text hash), null ids last, stays; all columns are
    kept.

    A component without any id keeps one row too.
    """
    return keep_first(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that come first in their component; ``found`` is what a near_duplicates gives."""
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("first")
    kept = durable(found.groupBy(group.alias("g")).agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")))
    names = docs.columns
    wide = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    wide = wide.withColumn("kept_id", ident.cast("long")).withColumn("kept_hash", F.xxhash64(text))
    same = wide["kept_id"].eqNullSafe(kept["kept_id"]) & (wide["kept_hash"] == kept["kept_hash"])
    from pyspark.sql import Window

    once = wide.join(kept, same, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("kept_id", "kept_hash").orderBy("kept_id")))
    return once.where("nth = 1").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


