"""Vector code compression: product codes from integer codebooks, trained by Yinyang Lloyd rounds.

Components become integers, floor(SCALE * x). A vector is cut into equal consecutive parts, and each part position has a codebook whose
entries start as that part of the first vectors by id. A round assigns every part to its nearest entry and moves each entry to the
floor of the mean of its parts. Entries are clustered into a few groups. A part carries an upper bound of the distance to its own
entry and, for each group, one lower bound of the distance to the group's other entries. After a round the bounds drift: the upper one by
the move of the own entry, a lower one by the largest move in its group. A part whose upper bound lies below all lower ones keeps its
entry unseen; else the upper bound is made exact, and only the groups whose lower bound still does not exceed it are scanned. Bounds are
rounded outwards, and whatever is scanned is compared in exact integers, ties to the lower index; so the codes equal those of full scans.

A round is one pass over a table in the shared folder that holds vectors and bounds: each task writes its rows for the next round and, in
its last row, the sums of its parts by entry, cut into limbs of 30 bits. No row is shuffled: the sums of all tasks are added up as a table of
fixed size, from which the driver makes the next codebooks. Distances are products of doubles that hold integers, exact as long as they
stay below 2 ** 53; where components are too large for that, the same code runs on Python integers.

Defined cases: rows whose vector is null or holds null or non-finite components leave; the vector length is that of the first kept row (by
id, null last, then by vector), and rows of another length stay with a null code and error; lengths that the number of parts does not divide
have parts that differ by one component; fewer rows than entries give as many entries; repeated rows, and rows of one id, count each and get
a row each; a null id comes last; errors beyond 64 bits are null, and so is the sum of a label that has such a one (else nulls are left out of it); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, remove, ship, table, written

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
#: Bits of a limb of a sum, and limbs of one: enough for single-precision components of any size.
LIMB, LIMBS = 30, 7
#: Largest component of single precision; what is larger counts as not finite.
LARGEST = 3.4028234663852886e38
#: Rows that are assigned at once.
_SLICE = 8192
_SUMS = "s array<bigint>"
_MOST = (1 << 63) - 1


def cuts(length: int, parts: int) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: doubles that hold integers, or Python integers where squares of those could pass 2 ** 53."""
    y = np.floor(x * SCALE)  # a power of two: exact
    if not y.size or 4.0 * y.shape[-1] * np.abs(y).max() ** 2 < 2.0**53:
        return y
    return np.array([[int(v) for v in row] for row in y], object).reshape(y.shape)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to entries."""
    if x.dtype == object or 4.0 * x.shape[1] * float(np.abs(entries).max(initial=0)) ** 2 >= 2.0**53:
        whole = np.frompyfunc(int, 1, 1)
        x, entries = whole(x).astype(object).reshape(x.shape), whole(entries).astype(object).reshape(entries.shape)
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    """Square roots in single precision, rounded outwards."""
    r = np.sqrt(d.astype(np.float64)) * (1 + 1e-6 if up else 1 - 1e-6)
    with np.errstate(over="ignore"):  # beyond single precision an upper bound is infinite
        return np.minimum(r, np.inf if up else 3e38).astype(np.float32)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries themselves."""
    x = entries.astype(np.float64)
    scale = np.abs(x).max(initial=0)
    x = x / scale if scale else x
    centres = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)] if len(x) else x
    own = np.zeros(len(x), int)
    for _ in range(5 if len(x) else 0):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[own == g].mean(0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(own, return_inverse=True)[1]


def assign(x: np.ndarray, entries: np.ndarray, group: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its upper bound, the lower bounds by group, and how many distances were made.

    ``state``: what this gave for the entries before, which have since ``moved`` so far.
    """
    n, groups = len(x), int(group.max()) + 1
    members = [np.flatnonzero(group == g) for g in range(groups)]
    if state is None:
        own, upper, lower = np.zeros(n, np.uint8), np.full(n, np.inf, np.float32), np.zeros((n, groups), np.float32)
        asks = np.ones(n, bool)
        made = 0
    else:
        own, upper, lower = (a.copy() for a in state)
        upper = np.nextafter(upper + moved[own], np.float32(np.inf))
        drift = np.array([moved[m].max(initial=0) for m in members], np.float32)
        lower = np.maximum(np.nextafter(lower - drift, np.float32(-np.inf)), 0)
        asks = ~(upper < lower.min(1))
        made = int(asks.sum())
    rows = np.flatnonzero(asks)
    if not len(rows):
        return own, upper, lower, made
    was = own[rows]
    # Exact distance to the entry that a part has, entry by entry.
    best = np.zeros(len(rows), np.float64 if x.dtype != object else object)
    for e in np.unique(was):
        at = np.flatnonzero(was == e)
        d = distances(x[rows[at]], entries[e : e + 1])[:, 0]
        if d.dtype == object:
            best = best.astype(object)
        best[at] = d
    near = _root(best, True)
    scans = lower[rows] <= near[:, None]
    nearest, low = was.astype(np.int64), lower[rows]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g, m in enumerate(members):
        at = np.flatnonzero(scans[:, g])
        if not len(at):
            continue
        d = distances(x[rows[at]], entries[m])
        made += d.size
        if d.dtype == object and best.dtype != object:
            best = best.astype(object)
        k = d.argmin(1)  # the first of equal ones
        least = d[np.arange(len(at)), k]
        better = (least < best[at]) | ((least == best[at]) & (m[k] < nearest[at]))
        best[at] = np.where(better, least, best[at])
        nearest[at] = np.where(better, m[k], nearest[at])
        found.append((at, m, d))
    for at, m, d in found:  # the lower bound leaves out the entry that was chosen
        rest = np.where(m == nearest[at][:, None], np.float64(np.inf), d.astype(np.float64))
        low[at, group[m[0]]] = _root(rest.min(1), False)
    left = nearest != was  # the entry left behind counts in its group, scanned or not
    if left.any():
        at = np.flatnonzero(left)
        behind = group[was[at]]
        low[at, behind] = np.minimum(low[at, behind], near[at] * np.float32(1 - 3e-6))
    own[rows], upper[rows], lower[rows] = nearest, _root(best, True), low
    return own, upper, lower, made


def limbs(v: int) -> list[int]:
    """Limbs that add up to v; all but the last are not negative."""
    return [(v >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)] + [v >> (LIMB * (LIMBS - 1))]


def sums_of(x: np.ndarray, own: np.ndarray, entries: int) -> np.ndarray:
    """For each entry the sum of its rows and, last, their number; Python integers."""
    out = np.zeros((entries, x.shape[1] + 1), object)
    for e in np.unique(own):
        rows = x[own == e]
        total = rows.sum(0) if rows.dtype == object or len(rows) * float(np.abs(rows).max(initial=0)) < 2.0**53 else np.array([[int(v) for v in r] for r in rows], object).sum(0)
        out[e] = [int(v) for v in total] + [len(rows)]
    return out


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), length)


def _bytes(a: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    a = np.ascontiguousarray(a)
    width = a[0].nbytes if len(a) else 0
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32)), pa.py_buffer(a.tobytes())])


def _numbers(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = bytes(data)[offsets[0] : offsets[-1]] if data is not None else b""
    return np.frombuffer(raw, kind).reshape(len(column), *shape).copy()


def _round(length: int, books: list[np.ndarray], groups: list[np.ndarray], moved: list[np.ndarray] | None, parts: int):
    """One pass: rows with new codes and bounds; the last row of a task carries the sums."""
    at = cuts(length, parts)
    wide = max(int(g.max()) + 1 for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
        for big in batches:
            for start in range(0, big.num_rows, _SLICE):
                b = big.slice(start, _SLICE)
                n = b.num_rows
                x = integers(_vectors(b.column("v"), length))
                code, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts, wide), np.float32)
                if moved is not None:
                    code, upper, lower = _numbers(b.column("code"), np.uint8, (parts,)), _numbers(b.column("upper"), np.float32, (parts,)), _numbers(b.column("lower"), np.float32, (parts, wide))
                for p in range(parts):
                    g = int(groups[p].max()) + 1
                    part = x[:, at[p] : at[p + 1]]
                    own, up, low, _ = assign(part, books[p], groups[p], None if moved is None else (code[:, p], upper[:, p], lower[:, p, :g]), None if moved is None else moved[p])
                    code[:, p], upper[:, p], lower[:, p, :g] = own, up, low
                    total[p] = total[p] + sums_of(part, own, len(books[p]))
                if held is not None:
                    yield held
                held = pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), _bytes(code), _bytes(upper), _bytes(lower.reshape(n, -1)), pa.nulls(n, pa.list_(pa.int64()))], names=["vec_id", "label", "v", "code", "upper", "lower", "s"])
        if held is not None:
            last = [v for t in total for number in t.ravel() for v in limbs(int(number))]
            s = pa.array([None] * (held.num_rows - 1) + [last], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], s], names=held.schema.names)

    return run


def _final(length: int, books: list[np.ndarray], groups: list[np.ndarray], moved: list[np.ndarray] | None, parts: int):
    at = cuts(length, parts)
    wide = max(int(g.max()) + 1 for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, _SLICE):
                b = big.slice(start, _SLICE)
                x = integers(_vectors(b.column("v"), length))
                code = np.zeros((b.num_rows, parts), np.uint8)
                error = np.zeros(b.num_rows, object)
                if moved is not None:
                    was, upper, lower = _numbers(b.column("code"), np.uint8, (parts,)), _numbers(b.column("upper"), np.float32, (parts,)), _numbers(b.column("lower"), np.float32, (parts, wide))
                for p in range(parts):
                    part = x[:, at[p] : at[p + 1]]
                    g = int(groups[p].max()) + 1
                    code[:, p] = assign(part, books[p], groups[p], None if moved is None else (was[:, p], upper[:, p], lower[:, p, :g]), None if moved is None else moved[p])[0]
                    for e in np.unique(code[:, p]):
                        rows = np.flatnonzero(code[:, p] == e)
                        error[rows] += distances(part[rows], books[p][e : e + 1])[:, 0].astype(object)
                whole = [int(v) for v in error]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array([v if v <= _MOST else None for v in whole], pa.int64())], names=["vec_id", "label", "code", "error"],
                )

    return run


def books_of(first: np.ndarray, parts: int) -> list[np.ndarray]:
    at = cuts(first.shape[1], parts)
    return [first[:, at[p] : at[p + 1]] for p in range(parts)]


def moved_to(books: list[np.ndarray], totals: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The next codebooks from all sums, in the order of ``_round``, and how far entries moved (rounded up)."""
    new, far, k = [], [], 0
    for book in books:
        size = (len(book), book.shape[1] + 1)
        own = np.array(totals[k : k + size[0] * size[1]], object).reshape(size)
        k += size[0] * size[1]
        nxt = np.array([[int(v) for v in row] for row in book], object).reshape(book.shape)
        for e in range(len(book)):
            if own[e, -1]:
                nxt[e] = [int(v) // int(own[e, -1]) for v in own[e, :-1]]
        old = np.array([[int(v) for v in row] for row in book], object).reshape(book.shape)
        far.append(_root(((nxt - old) ** 2).sum(1) if book.shape[1] else np.zeros(len(book)), True))
        top = max((abs(int(v)) for v in nxt.ravel()), default=0)
        new.append(nxt.astype(np.float64) if 4 * max(1, book.shape[1]) * top**2 < 2**53 else nxt)
    return new, far


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error) for each kept row, and the codebooks: components by part, entry and position."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST)))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    head = rows.orderBy(*by_id).select(F.size("v").alias("n")).head()
    none = rows.limit(0).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if head is None:
        return none, []
    length = head.n
    other = rows.where(F.size("v") != length).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = rows.where(F.size("v") == length)
    first = rows.orderBy(*by_id).limit(entries).select("v").toArrow().column("v").combine_chunks()  # ``entries`` rows
    first = pa.concat_arrays(first.chunks) if isinstance(first, pa.ChunkedArray) else first
    books = books_of(integers(_vectors(first, length)), parts)
    clusters = [grouped(b, groups) for b in books]
    moved, state, path = None, rows, None
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = f"vec_id long, label {kinds['label']}, v array<double>, code binary, upper binary, lower binary, {_SUMS}"
    for _ in range(rounds):
        state, new = written(state.mapInArrow(lean(_round(length, books, clusters, moved, parts)), made))
        if path:
            remove(spark, path)
        path = new
        each = state.where("s is not null").select(F.posexplode("s").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).toArrow()  # parts * entries * (width + 1) * LIMBS rows
        x = np.zeros(sum(b.size + len(b) for b in books) * LIMBS, object)
        for k, value in zip(each.column("k").to_pylist(), each.column("x").to_pylist(), strict=True):
            x[k] = value
        totals = [sum(int(v) << (LIMB * i) for i, v in enumerate(x[k : k + LIMBS])) for k in range(0, len(x), LIMBS)]
        books, moved = moved_to(books, totals)
    done = durable(state.mapInArrow(lean(_final(length, books, clusters, moved, parts)), f"vec_id long, label {kinds['label']}, code string, error long"))
    if path:
        remove(spark, path)
    return done.union(other), [[[int(v) for v in e] for e in b] for b in books]


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    beyond = F.count_if(F.col("error").isNull() & F.col("code").isNotNull()) > 0
    by_label = coded.groupBy("label").agg(F.when(~beyond, wide).try_cast("long").alias("label_error")).withColumnRenamed("label", "of")
    rows = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of op11, for vectors of one length that ``parts`` divides and ids that do not repeat: full scans, a CTE for each step."""
    step = """
d{n} AS MATERIALIZED (SELECT x.id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{n} b ON b.p = x.p),
a{n} AS MATERIALIZED (SELECT id, p, e, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY d, e) = 1)"""
    move = """,
u{n} AS (SELECT a.p, a.e, i, sum(x.v[i]) AS s, count(*) AS c FROM a{n} a JOIN x ON x.id = a.id AND x.p = a.p, range(1, (SELECT w + 1 FROM w)) t(i) GROUP BY a.p, a.e, i),
n{n} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i)::BIGINT[] AS v FROM u{n} GROUP BY p, e),
b{m} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{n} b LEFT JOIN n{n} n ON n.p = b.p AND n.e = b.e),"""
    body = "".join(step.format(n=n) + (move.format(n=n, m=n + 1) if n < rounds else "") for n in range(rounds + 1))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda c: floor({SCALE} * c)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
w AS (SELECT max(len(v)) // {parts} AS w FROM k),
x AS MATERIALIZED (SELECT id, p, list_slice(v, p * w + 1, (p + 1) * w) AS v FROM k, w, range({parts}) t(p)),
f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM k QUALIFY row_number() OVER (ORDER BY id) <= {entries}),
b0 AS MATERIALIZED (SELECT x.p, f.e, x.v FROM f JOIN x USING (id)),{body},
r AS (SELECT id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT k.id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN r USING (id), h"""
