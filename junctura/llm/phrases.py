"""Phrase collocations: frequent phrases of adjacent words, each scored by its weakest cut.

Phrases are counted level by level, by their number of words. Only Apriori-safe phrases become candidates: those whose two phrases of one word
less may both be frequent. What may be is known from a filter of fixed size, one for each level, built from the frequent phrases as
bitmaps; a false positive only adds a candidate. Mappers turn the words of a slice of texts into numbers and count the candidates of the
slice in numpy arrays. These counts go to shards by the hash of the phrase, as one row for each phrase of a slice, so a phrase of any
frequency is spread over the mappers before it meets in one place. A shard makes a minimal perfect hash over its candidates, looks up the slot
of each row, verifies the key stored there (rows that another key holds go to a further hash of the same kind), and adds the counts up by
slot. Cuts are read likewise: the frequent phrases are dealt to cells, each with a perfect hash over its keys, and every part of a cut
asks its cell for the count in its slot; the requests of a cell are dealt over copies of it, as many as keep them below a bound.

The number of shards, cells and copies follows the counts, so no task holds more than about a set number of rows. Nothing is cut off but
the report itself, the first ``top`` phrases of each language.

Defined cases: a null text is empty, a null language ``und``; texts are read whole, at least one at a time, so working memory follows the
longest text and ``SLICE``; repeated rows count each; ids are not used; ties are ordered by frequency, then by the bytes of the phrase; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, lean, remove, ship, table, written

#: Bytes of text whose phrases are counted at once, words for each shard, and keys and requests of a cell, about.
SLICE, SHARD, CELL, ASKED = 6 << 20, 2_000_000, 200_000, 400_000
#: Bits of a filter, as a power of two: 8 MB.
FILTER = 26
_BLOCK = 1 << 15
_BREAK = b"\xff"  # no byte of UTF-8
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(_UPPER + _ENDS + b"\t", _LOWER + b"\n" * len(_ENDS) + b" ")
#: Odd, so that no two places of up to 64 words turn alike.
_TURN = 21
_COUNTED = "lang string, phrase string, n long"


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of texts as numbers, with 0 between pieces, and the words by number."""
    flat = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" " + _BREAK + b" ")
    coded = pa.array([_BREAK, *flat.split()], pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hashes(lang: bytes, words: pa.Array) -> np.ndarray:
    """As Spark's xxhash64(lang, word)."""
    seed, of = xxhash.xxh64_intdigest(lang, 42), xxhash.xxh64_intdigest
    return np.fromiter((of(k, seed) for k in words.to_pylist()), np.uint64, len(words))


def turned(h: np.ndarray, place: int) -> np.ndarray:
    """Hashes of words at a place of a phrase: rotated left by _TURN bits for each place. A phrase's hash is the sum of these, bit by bit
    without carry."""
    k = _TURN * place % 64
    return (h << np.uint64(k)) | (h >> np.uint64(64 - k)) if k else h


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter may hold keys of these hashes."""
    mask = np.uint64(8 * len(bits) - 1)
    out = np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def filter_of(rows: DataFrame, power: int = FILTER) -> np.ndarray:
    """A filter of 2 ** power bits over (lang, phrase), two bits a key, by the hashes that ``phrases_of`` makes of its words."""
    def turn(w: Column, place: Column) -> Column:
        h, k = F.xxhash64("lang", w), (place * _TURN % 64).cast("int")
        return F.expr("cast(0 as bigint)").bitwiseXOR(F.call_function("shiftleft", h, k).bitwiseOR(F.when(k > 0, F.call_function("shiftrightunsigned", h, 64 - k)).otherwise(F.lit(0).cast("bigint"))))

    parts, mask = F.transform(F.split("phrase", " "), turn), F.lit((1 << power) - 1)
    h = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
    spots = rows.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("spot"))
    blocks = spots.groupBy(F.floor(F.col("spot") / _BLOCK).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("spot") % _BLOCK).alias("bits"))
    out = np.zeros((max(1, (1 << power) // _BLOCK), _BLOCK // 8), np.uint8)
    for block, bits in blocks.toLocalIterator():  # 2 ** power / 2 ** 15 rows of 4 KB at most
        out[block] = np.frombuffer(bytes(bits), np.uint8)
    return out.ravel()[: (1 << power) // 8]


def phrases_of(texts: list[bytes], lang: bytes, filters: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The distinct candidates of one word more than there are filters, and how often each occurs in the texts."""
    ids, words = words_of(texts)
    names, n = words, np.bincount(ids, minlength=len(words))
    n[0] = 0
    at = np.where(ids > 0, ids, -1).astype(np.int64)
    own_hash = hashes(lang, words) if filters else np.zeros(0, np.uint64)
    h = own_hash
    for level, bits in enumerate(filters, 1):
        if not len(names):
            break
        safe = may_hold(bits, h)
        at = np.where((at >= 0) & safe[at], at, -1)
        both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        own, which, n = np.unique(at[both] * len(words) + ids[both + level], return_inverse=True, return_counts=True)
        first, last = own // len(words), own % len(words)
        names = pc.binary_join_element_wise(names.take(pa.array(first)), words.take(pa.array(last)), b" ")
        h = h[first] ^ turned(own_hash, level)[last]
        at = np.full(max(0, len(at) - 1), -1)
        at[both] = which
    some = n > 0
    return names.filter(pa.array(some)), n[some]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[bytes, list[bytes]]]:
    """Texts of one language, together about ``most`` bytes."""
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).cast(pa.binary()), b.column(1).cast(pa.binary()), strict=True):
            one = text.as_py()
            held.setdefault(lang.as_py(), []).append(one)
            size += len(one) + 1
            if size >= most:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


class Slots:
    """A minimal perfect hash over distinct 64-bit keys: levels of bit arrays, in each of which the keys that are alone at their bit get
    the bit's rank as slot, while the others go on to the next. Other keys get any slot, or -1: the caller verifies."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        while len(keys):
            at = self._spots(keys, len(self.levels), 2 * len(keys) + 1)
            alone = np.bincount(at, minlength=2 * len(keys) + 1) == 1
            self.levels.append((alone, (np.cumsum(alone) - 1 + self.size).astype(np.int64)))
            self.size += int(alone.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def _spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._spots(keys[rest], level, len(alone))
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


class Keys:
    """Perfect hashes over (lang, phrase) with the keys stored by slot. Keys of one 64-bit hash go to further hashes."""

    def __init__(self, lang: pa.Array, phrase: pa.Array, h: np.ndarray):
        self.parts: list[tuple[Slots, pa.Array, pa.Array]] = []
        self.size, rest = 0, np.arange(len(h))
        while len(rest):
            slots = Slots(np.unique(h[rest]))
            at = slots.of(h[rest])
            owner = np.empty(slots.size, np.int64)
            owner[at[::-1]] = rest[::-1]
            self.parts.append((slots, lang.take(pa.array(owner)), phrase.take(pa.array(owner))))
            self.size += slots.size
            rest = rest[~self._equal(self.parts[-1], at, lang.take(pa.array(rest)), phrase.take(pa.array(rest)))]

    @staticmethod
    def _equal(part: tuple[Slots, pa.Array, pa.Array], at: np.ndarray, lang: pa.Array, phrase: pa.Array) -> np.ndarray:
        where = pa.array(at, mask=at < 0)
        same = pc.and_(pc.equal(part[1].take(where), lang), pc.equal(part[2].take(where), phrase))
        return same.fill_null(False).to_numpy(zero_copy_only=False)

    def of(self, lang: pa.Array, phrase: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those not here."""
        out, rest, base = np.full(len(h), -1), np.arange(len(h)), 0
        for part in self.parts:
            at = part[0].of(h[rest])
            same = self._equal(part, at, lang.take(pa.array(rest)), phrase.take(pa.array(rest)))
            out[rest[same]] = base + at[same]
            rest, base = rest[~same], base + part[0].size
        return out

    def stored(self) -> tuple[pa.Array, pa.Array]:
        return tuple(pa.concat_arrays([p[k] for p in self.parts]) for k in (1, 2))


def _columns(t: pa.Table) -> list[pa.Array]:
    one = [c.combine_chunks() for c in t.columns]
    return [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in one]


def counted(docs: DataFrame, filters: list[np.ndarray], least: int, shards: int) -> DataFrame:
    """(lang, phrase, f) of the frequent phrases of one word more than there are filters; of all words if there are none."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in slices(batches):
            names, n = phrases_of(texts, lang, shared.value)
            for at in range(0, len(names), 50_000):
                part = names.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(part), pa.string()), part.cast(pa.string()), pa.array(n[at : at + 50_000], pa.int64())], names=["lang", "phrase", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        lang, phrase, n, h = _columns(pa.Table.from_batches(held))
        h = h.to_numpy(zero_copy_only=False).view(np.uint64)
        keys = Keys(lang, phrase, h)
        # In doubles: exact below 2 ** 53 occurrences in a shard.
        f = np.bincount(keys.of(lang, phrase, h), weights=n.to_numpy(zero_copy_only=False), minlength=keys.size).astype(np.int64)
        lang, phrase = keys.stored()
        often = np.flatnonzero(f >= least)
        for at in range(0, len(often), 50_000):
            part = often[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(part)), phrase.take(pa.array(part)), pa.array(f[part])], names=["lang", "phrase", "f"])

    rows = docs.mapInArrow(lean(count), _COUNTED)
    if not filters:
        return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    rows = rows.withColumn("h", F.xxhash64("lang", "phrase")).repartition(shards, "h")
    return rows.mapInArrow(lean(add), "lang string, phrase string, f long")


def looked_up(asked: DataFrame, known: DataFrame, extra: list[str], cell: int = CELL, most: int = ASKED) -> DataFrame:
    """``extra`` columns of ``asked`` (lang, part and those) with f, the count of the part in ``known`` (lang, phrase, f). The number of cells follows
    ``known``; each has so many copies that the requests of one are ``most`` at most, about."""
    cells = max(1, -(-known.count() // cell))
    at = lambda c: F.pmod(F.xxhash64("lang", c), F.lit(cells)).cast("int")
    asked = asked.withColumn("cell", at("part"))
    largest = asked.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    copies = max(1, -(-largest // most))
    left = asked.withColumn("copy", F.pmod(F.xxhash64(F.lit("copy"), "part", *extra), F.lit(copies)).cast("int")).withColumn("h", F.xxhash64("lang", "part"))
    right = known.withColumn("cell", at("phrase")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("h", F.xxhash64("lang", "phrase"))
    shape = left.select(*extra).schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.fields) + ", f long"

    def read(requests: pa.Table, entries: pa.Table) -> pa.Table:
        lang, phrase, f, h = _columns(entries.select(["lang", "phrase", "f", "h"]))
        keys = Keys(lang, phrase, h.to_numpy(zero_copy_only=False).view(np.uint64))
        by_slot = np.zeros(keys.size, np.int64)
        by_slot[keys.of(lang, phrase, h.to_numpy(zero_copy_only=False).view(np.uint64))] = f.to_numpy(zero_copy_only=False)
        lang, part, h = _columns(requests.select(["lang", "part", "h"]))
        slot = keys.of(lang, part, h.to_numpy(zero_copy_only=False).view(np.uint64))
        return requests.select(extra).append_column("f", pa.array(by_slot[slot] if keys.size else np.zeros(len(slot), np.int64), mask=slot < 0))

    key = ["cell", "copy"]
    return left.groupBy(*key).cogroup(right.select(*key, "lang", "phrase", "f", "h").groupBy(*key)).applyInArrow(read, out)


def _part(first, length) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50, text_col: str = "text", lang_col: str = "lang", power: int = FILTER, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words that occur ``least`` times or more, without those that
    lie in a longer one with at least ``covered`` percent of their occurrences; the first ``top`` of each language."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, path = written(counted(texts, [], least, 1))
    paths, levels, filters = [path], [words.where(F.col("f") >= least)], []
    totals = durable(words.groupBy(F.col("lang").alias("of")).agg(F.sum("f").alias("n")))
    shards = max(1, -(-int(totals.agg(F.sum("n")).first()[0] or 0) // shard))
    for _ in range(2, longest + 1):
        filters.append(filter_of(levels[-1], power))
        found, path = written(counted(texts, filters, least, shards))
        paths.append(path)
        levels.append(found)
    # What lies in a longer phrase with most of its occurrences goes.
    kept = None
    for k in range(2, longest + 1):
        own = levels[k - 1].select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"))
        for more in range(k + 1, longest + 1):
            inside = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(more - k + 1)), lambda i: _part(i, F.lit(k))))  # noqa: B023
            cover = levels[more - 1].select(F.col("lang").alias("in_lang"), F.explode(inside).alias("in_phrase"), "f").groupBy("in_lang", "in_phrase").agg(F.max("f").alias("most"))
            own = own.join(cover, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
            own = own.where(F.col("most").isNull() | (F.col("most").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * covered)).select("lang", "phrase", "a", "k")
        kept = own if kept is None else kept.union(own)
    kept = durable(kept)
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = kept.select("lang", "phrase", "a", "k", cut)
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), _part(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part"))))
    asked = cuts.select("lang", "phrase", "a", "cut", sides.alias("s")).select("lang", "phrase", "a", "cut", "s.side", "s.part")
    known = None
    for level in levels[: longest - 1]:
        known = level if known is None else known.union(level)
    got = looked_up(asked, known, ["lang", "phrase", "a", "cut", "side"])
    each = lambda side, c: F.max(F.when((F.col("side") == side) & (F.col("cut") == c), F.col("f")))
    rows = got.groupBy("lang", "phrase", "a").agg(*[each(s, c).alias(f"{s}{c}") for c in range(1, longest) for s in "lr"])
    score = lambda c: F.expr(f"(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(l{c} as decimal(38,0)) * cast(r{c} as decimal(38,0)))")
    best = F.array_min(F.filter(F.array(*[F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, longest)]), lambda x: x["score"].isNotNull()))
    rows = rows.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    rows = rows.join(totals, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = durable(rows)
    for path in paths:
        remove(spark, path)
    return out


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    rows = collocations(table(spark, sf_dir, "documents"))
    return rows.withColumn("rank", F.col("rank").cast("long"))


SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
inside AS (SELECT lang, phrase2 AS phrase, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase2 FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside i ON c.k = 2 AND i.lang = c.lang AND i.phrase = c.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * c.a),
cuts AS (SELECT k.lang, k.phrase, k.a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) k
         JOIN f l ON l.lang = k.lang AND l.k = cut AND l.phrase = array_to_string(list_slice(w, 1, cut), ' ') JOIN f r ON r.lang = k.lang AND r.k = k.k - cut AND r.phrase = array_to_string(list_slice(w, cut + 1, k.k), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000
"""
