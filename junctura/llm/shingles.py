"""SimHash near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

At 0.8 the 64-bit fingerprints of two texts lie some 10 bits apart, too many for blocks of equal bits. So a fingerprint here is long,
and its blocks follow the shingles: a shingle's hash deals it to a block, and a block's 64 bits are the majority bits of its own
shingles. An edit changes only the blocks of the shingles it touches. Two sets of that similarity differ in at most a quarter of
the smaller one, so with about a block for each ``FILL`` shingles many blocks are equal, as pigeonholes go, and texts are joined
on blocks. Sets of a size class have as many blocks, and sets close to the next class are dealt in both ways. ``KEYS`` blocks are used; small
sets have fewer and are dealt several times. A pair of 0.8 shares no block with a chance of about (1 - 1/e) ** KEYS, 1e-8.

Pairs that meet are verified by the Hamming distance of whole fingerprints of 128 bits (``FAR`` at most, five standard deviations
beyond what 0.8 gives, four below what unrelated texts have) and, within components of such links, again so and by the sets themselves, so
every link is exact. Equal sets are one class
before that. Components are split into cells of about ``CELL`` shingles, and each pair of cells is a group of its own, so no group
holds more than two cells however large a component is.

Defined cases: words and short texts are those of ``simhash.fingerprint``; null and empty texts have the empty set, linked with each
other only; repeated rows each get a row; null ids count as no id; very long texts are taken whole, 8 bytes a word in one task; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, ship
from .simhash import _apart, components, grouped_links, keep_first

KEYS, FILL, FAR = 40, 2.5, 40
#: Shingles that a cell of a component holds, about.
CELL = 2_000_000


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = max(0, len(words) - shingle)
    parts = [joined[s:e] for s, e in zip(starts[: last + 1].tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts)))


def _majority(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The majority bits of each run of hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits.astype(np.int32), begins, axis=0)
    sizes = np.diff(np.append(begins, len(hashes)))
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprint_of(hashes: np.ndarray) -> tuple[int, int]:
    """The 128-bit fingerprint of a set, as two signed words."""
    out = []
    for k in range(2):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            part = hashes[at : at + 65536]
            if k:
                part = (part ^ (part >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
                part = part ^ (part >> np.uint64(32))
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]))
    return out[0], out[1]


def _classes(n: int, similarity: float) -> list[int]:
    """The size classes of a set of n shingles: its own, and the next where a partner may be in that."""
    own = int(np.floor(np.log2(n) * 1.5))
    most = int(np.floor(np.log2(n / similarity + 1e-9) * 1.5))
    return list(range(own, most + 1))


def block_keys(hashes: np.ndarray, similarity: float = 0.8) -> np.ndarray:
    """Keys of the blocks of a set, under each of its size classes; blocks without a shingle have none."""
    out = []
    for size in _classes(len(hashes), similarity) if len(hashes) > 3 else ():  # smaller sets are linked only if equal
        blocks = max(2, int(2 ** (size / 1.5) / FILL) + 1)
        for nth in range(-(-KEYS // blocks)):
            # The multiplier differs with each dealing, so that blocks of several dealings hold other shingles.
            place = ((hashes * np.uint64(2 * nth + 0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            use = place < KEYS
            order = np.argsort(place[use], kind="stable")
            held, at = hashes[use][order], place[use][order]
            if not len(held):
                continue
            begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            named = (at[begins] + np.uint64(1000 * nth + 1_000_000 * size)) * np.uint64(0xC2B2AE3D27D4EB4F)
            key = (_majority(held, begins) ^ named) * np.uint64(0x165667B19E3779F9)
            out.append(key ^ (key >> np.uint64(29)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def linked(sets: list[np.ndarray], bits: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets that are not empty, as places; ``bits`` are their fingerprints, by which most pairs
    are ruled out before their sets are compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rest, out = np.arange(1, len(sets)), []
    frontier = [0]
    while len(rest):
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
            continue
        at = frontier.pop()
        own, n = sets[at], sizes[rest]
        maybe = np.flatnonzero((np.minimum(n, len(own)) >= similarity * np.maximum(n, len(own)) - 1e-9) & (_apart(bits[rest], bits[at]) <= FAR))
        near = np.zeros(len(rest), bool)
        for i in maybe.tolist():
            other = sets[rest[i]]
            small, large = (own, other) if len(own) <= len(other) else (other, own)
            both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            near[i] = both >= similarity * (len(own) + len(other) - both) - 1e-9
        if near.any():
            reached = rest[near].tolist()
            out += [(at, x) for x in reached]
            frontier += reached
            rest = rest[~near]
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, cell: int = CELL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, fp (names the set), component_id (smallest id reachable over links)."""
    ship(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = b.column(2).cast(pa.binary())
            names, bits, sizes, blocks = [], [], [], []
            for i in range(len(texts)):
                own = shingle_set(texts[i].as_py(), shingle)
                names.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                bits.append(fingerprint_of(own))
                sizes.append(len(own))
                blocks.append(block_keys(own, similarity))
            fps = pa.array(np.array(names, np.uint64).view(np.int64))
            columns = [b.column(0), b.column(1), fps, pa.array([x for x, _ in bits], pa.int64()), pa.array([x for _, x in bits], pa.int64()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "bits", "more", "size", "blocks"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(5).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([shingle_set(texts[i].as_py(), shingle).tobytes() for i in range(len(texts))], pa.large_binary())], names=["fp", "root", "cells", "bits", "more", "hashes"])

    def search(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("fp").to_numpy())
        names = group.column("fp").to_numpy()[order]
        bits = np.stack([group.column(c).to_numpy() for c in ("bits", "more")], axis=1).view(np.uint64)[order]
        hashes = group.column("hashes")
        pairs = linked([np.frombuffer(hashes[i].as_buffer(), np.uint64) for i in order.tolist()], bits, similarity)
        return pa.table({"a": pa.array([names[x] for x, _ in pairs], pa.int64()), "b": pa.array([names[y] for _, y in pairs], pa.int64())})

    rows = durable(_texts(docs, id_col, text_col).mapInArrow(lean(keys), "doc_id long, text_hash long, fp long, bits long, more long, size long, blocks array<long>"))
    first = F.min(F.struct("doc_id", "text_hash")).alias("one")
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), first, F.first("bits").alias("bits"), F.first("more").alias("more"), F.first("size").alias("size"), F.first("blocks").alias("blocks")))
    keyed = classes.select(F.struct("bits", "more", "fp").alias("member"), F.explode("blocks").alias("key"))
    roots = durable(components(grouped_links(keyed, FAR)).select(F.col("node").alias("fp"), "root"))
    known = classes.select("fp", "size", "bits", "more", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
    sized = roots.join(known, "fp")
    # Components of more than one cell: their members are dealt into cells, and go to each pair of cells that holds their own.
    cells = durable(sized.groupBy("root").agg(F.ceil(F.sum("size") / cell).cast("int").alias("cells")).where("cells > 1"))
    sized = sized.join(cells, "root", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    wide = _texts(docs, id_col, text_col)
    taken = wide.join(sized, wide["doc_id"].eqNullSafe(sized["one_id"]) & (wide["text_hash"] == sized["one_hash"])).select("fp", "root", "cells", "bits", "more", "text").dropDuplicates(["fp"])
    own = F.pmod(F.xxhash64("fp"), "cells").cast("int")
    dealt = taken.mapInArrow(lean(sets), "fp long, root long, cells int, bits long, more long, hashes binary").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    links = dealt.groupBy("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).applyInArrow(search, "a long, b long")
    named = durable(classes.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    ids = durable(named.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = durable(named.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the first row of each component, as ``simhash.one_of_each`` chooses it."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)
