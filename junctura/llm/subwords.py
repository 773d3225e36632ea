"""Quality: supervised subword embeddings. A text is the mean of learned vectors of its words and their character n-grams, hashed into
buckets; a softmax over that mean tells the label.

Words are what spaces and U+0009 to U+000D separate, with case and punctuation as they are, since these tell junk from prose. A word
between marks has n-grams of ``GRAMS`` characters. A text also has three pseudo-words, for its number of words, for the share of its words that
stand in lines seen before in it, and for the share that equal the word before them, all in steps. Training is stochastic gradient descent in numpy over one text after another, vectors and
softmax together, with a falling rate. As the softmax is linear in the mean, the fitted vectors fold into one number for each bucket, so
scoring a text is one mean of looked-up numbers. Scores are calibrated by a logistic fit on labelled texts kept apart.

The labelled sample is bounded by ``max_texts`` texts of each label, the first by a hash of their ids; the model is fitted in one task
on the buckets of these, counted over whole texts. Scoring covers all rows and whole texts, in parts of ``PART`` characters.

Defined cases: a null or empty text has only its pseudo-words, and scores by them; very long texts count whole; words of more than ``WIDE`` characters have the same
n-grams and a hash of all their characters; a null id is not held out and has no label; without both labels every text
scores the share of label 1 (0 without labels); repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, table

BUCKETS, SIZE, GRAMS = 1 << 17, 12, (3, 4)
#: Characters that are hashed at once.
PART = 1 << 20
#: Buckets at the end, for the pseudo-words: 24 steps of the number of words, 12 of the share of repeated lines, 12 of that of repeated words.
STEPS = (24, 12, 12)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(33, bool)
_BLANK[[32, *range(9, 14)]] = True


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS - sum(STEPS))).astype(np.int64)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def buckets(text: str) -> tuple[np.ndarray, int, int]:
    """Buckets of all words and n-grams of a piece of text, its number of words, and of those that equal the one before. Blanks around the
    piece are assumed."""
    x = codes(f" {text} ")
    blank = np.zeros(len(x), bool)
    low = x < 33
    blank[low] = _BLANK[x[low]]
    x = np.where(blank, np.uint32(32), x).astype(np.uint64) + np.uint64(1)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edge[::2] + 1, edge[1::2] + 1
    if not len(begin):
        return np.zeros(0, np.int64), 0, 0
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _powers(len(x), _BASE), dtype=np.uint64)))
    word = (sums[end] - sums[begin]) * _powers(len(x) + 1, _INVERSE)[begin]
    out = [_bucket(word + np.uint64(77))]
    for g in GRAMS:
        n = len(x) - g + 1
        if n < 1:
            continue
        h = np.zeros(n, np.uint64)
        inside = np.ones(n, bool)
        for k in range(g):
            h = h * np.uint64(0x100000001B3) + x[k : n + k]
            if 0 < k < g - 1:
                inside &= ~blank[k : n + k]  # a blank may only be the mark at an end
        out.append(_bucket(h[inside] + np.uint64(g)))
    return np.concatenate(out), len(begin), int((word[1:] == word[:-1]).sum())


def pieces(text: str) -> Iterator[str]:
    """A text in parts that end after whole lines or words where they can."""
    at = 0
    while len(text) - at > PART:
        end = max(text.rfind(" ", at + PART // 2, at + PART), text.rfind("\n", at + PART // 2, at + PART)) + 1 or at + PART
        yield text[at:end]
        at = end
    yield text[at:]


def steps(text: str, words: int, same: int) -> list[int]:
    """The buckets of the pseudo-words."""
    seen: set[str] = set()
    again = total = 0
    for line in text.split("\n"):
        if size := len(line.split()):
            total += size
            again += size if line in seen else 0
            seen.add(line)
    first = BUCKETS - sum(STEPS)
    share = lambda n, of, k: min(STEPS[k] - 1, -int(-(STEPS[k] - 1) * n // max(1, of)))  # noqa: E731  any at all is a step of its own
    return [first + min(STEPS[0] - 1, int(2 * np.log2(words + 1))), first + STEPS[0] + share(again, total, 1), first + sum(STEPS[:2]) + share(same, words, 2)]


def _mean(text: str | None, weights: np.ndarray, extra: float) -> float:
    """The mean of the weights of a text's buckets; its pseudo-words make up a share of ``extra``."""
    total, count, words, same = 0.0, 0, 0, 0
    for part in pieces(text or ""):
        own, n, again = buckets(part)
        total += float(weights[own].sum(dtype=np.float64))
        count += len(own)
        words += n
        same += again
    aside = float(weights[steps(text or "", words, same)].mean())
    return (1 - extra) * total / count + extra * aside if count else aside


def counted(text: str | None, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their shares of its mean."""
    count = np.zeros(BUCKETS, np.int64)
    words = same = 0
    for part in pieces(text or ""):
        own, n, again = buckets(part)
        count += np.bincount(own, minlength=BUCKETS)
        words += n
        same += again
    at = np.flatnonzero(count)
    share = count[at] / max(1, count[at].sum()) * (1 - extra if len(at) else 1)
    aside = steps(text or "", words, same)
    return np.append(at, aside), np.append(share, [(extra if len(at) else 1.0) / len(aside)] * len(aside)).astype(np.float32)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.1, least: int = 20_000, seed: int = 7) -> np.ndarray:
    """One weight for each bucket, and the bias last, from (label, buckets, shares) by stochastic gradient descent, in ``epochs`` rounds or as many as make ``least``
    steps. Both labels weigh the same in sum."""
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    out, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    y = np.array([k for k, _, _ in rows])
    weight = [len(y) / (2 * max(1, int((y == k).sum()))) for k in (0, 1)]
    epochs = max(epochs, -(-least // len(rows)))
    n, done = len(rows) * epochs, 0
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            label, at, share = rows[i]
            step = np.float32(rate * (1 - done / n) * weight[label])
            own = vectors[at]
            mean = share @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= step * mean[:, None] * p
            bias -= step * p
            # Shares are small, so a vector's step is scaled up by their norm.
            vectors[at] = own - (step / float(np.sqrt(share @ share))) * share[:, None] * back
            done += 1
    fold = out[:, 1] - out[:, 0]
    return np.append(vectors @ fold, bias[1] - bias[0]).astype(np.float32)


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on values, by Newton steps, with Platt's smoothed targets."""
    ones = float(y.sum())
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x = np.stack([x, np.ones(len(x))], 1)
    w = np.array([0.0, np.log((ones + 1) / (len(y) - ones + 1))])
    penalty = np.array([1e-3 * len(y), 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - t) + penalty * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_texts: int = 2000, extra: float = 0.3, epochs: int = 8, rate: float = 0.1) -> dict:
    """Fits on ``docs`` joined with ``labels``; ``usable`` (a column over the id) says which labels may be learnt. ``extra``: share of the pseudo-words in
    a text's mean. A quarter of the texts is kept apart for calibration; where it lacks a label, all are used for it."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    if usable is not None:
        known = known.where(usable(F.col("id")))
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_texts) for y in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # 2 * max_texts ids at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))  # one row for each id

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, share = counted(b.column(2)[i].as_py(), extra)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([at.astype(np.int32).tobytes()]), pa.array([share.tobytes()])], names=["id", "y", "at", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0)[i].as_py(), b.column(1)[i].as_py(), np.frombuffer(b.column(2)[i].as_py(), np.int32), np.frombuffer(b.column(3)[i].as_py(), np.float32)) for b in batches for i in range(b.num_rows)]
        rows.sort(key=lambda r: r[:2])
        if len({y for _, y, _, _ in rows}) < 2:
            return
        apart = [r for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFF, r[0]))) if n % 4 == 0]  # of each label
        ids = {r[:2] for r in apart}
        rest = [r for r in rows if r[:2] not in ids]
        if any(len({r[1] for r in side}) < 2 for side in (apart, rest)):
            apart = rest = rows
        weights = fit([r[1:] for r in rest], epochs, rate)
        value = np.array([float(share @ weights[:-1][at]) + float(weights[-1]) for _, _, at, share in apart])
        slope, offset = calibrated(value, np.array([y for _, y, _, _ in apart], float))
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "slope": [slope], "offset": [offset]})

    found = texts.mapInArrow(lean(count), "id long, y int, at binary, share binary").repartition(1).mapInArrow(lean(learn), "weights binary, slope double, offset double").first()  # 2 * max_texts rows
    if found is None:
        ones, every = known.agg(F.count_if(F.col("y") == 1), F.count("*")).first()
        share = (ones / every if every else 0.0) * (1 - 2e-9) + 1e-9
        return {"weights": np.zeros(BUCKETS + 1, np.float32), "slope": 0.0, "offset": float(np.log(share / (1 - share))), "extra": extra}
    return {"weights": np.frombuffer(found.weights, np.float32), "slope": found.slope, "offset": found.offset, "extra": extra}


def score_of(text: str | None, model: dict) -> float:
    value = _mean(text, model["weights"][:-1], model["extra"]) + float(model["weights"][-1])
    return float(1 / (1 + np.exp(-np.clip(model["slope"] * value + model["offset"], -30, 30))))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score_of(t.as_py(), shared.value) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def held_out(ident):
    return F.coalesce(F.crc32(ident.cast("string")) % 4 == 2, F.lit(False))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
