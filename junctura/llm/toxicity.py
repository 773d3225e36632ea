"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nyström landmarks, trained on labelled sentences.

The kernel of two strings counts their common subsequences of three characters, each occurrence weighted by ``DECAY`` to the
power of the span it covers, up to ``SPAN`` characters, and is scaled by what strings of their lengths have. Strings are runs of
adjacent words in a sentence, one word or several of ``RUN`` characters at most, the spaces around and between them counted as characters.
So a match may skip an inserted character, a missing one, or spaces inside a word. A sentence's value is that of its best run, and
a text is judged by the largest few of its sentences, so long texts are not diluted.

Training. Sentences carry the label of their text; in a text labelled 1 only some deserve it. So the machine is fitted in
rounds, each taking as positive examples the words that set the texts of label 1 apart (at first by their odds, then by the machine's
own value too), and these with a character inserted, removed or followed by a space; as negative examples words and runs of
sentences labelled 0, the worst offenders of all rounds among them. Landmarks are strings of both kinds; the Nyström map of these is
whitened, the machine fitted on it, and since the kernel is an inner product of subsequence counts, the fitted expansion over
landmarks is folded into one weight for each hashed subsequence. So values are differences of running sums over the text. A text's largest
values and its length become a score by a logistic fit on labelled texts kept apart from the rest.

The labelled sample is bounded by two parameters: ``max_texts`` texts of each label, the first by a hash of their ids, and
``max_sentences`` sentences of these for each label, the first by a hash. Everything else covers all rows and whole texts.

Defined cases: a null or empty text has no sentence and scores like a text of harmless ones; very long texts are scored in parts of
whole sentences, sentences of more than ``LONG`` characters in overlapping pieces, words of more than ``WIDTH`` in overlapping pieces too, so
working memory does not grow with a text; a null id is not held out and has no label; without both labels every text scores the share of
label 1 (0 without labels); repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, table

SPAN, DECAY, BUCKETS = 6, 0.75, 1 << 16
#: Characters of a run of several words, words of a run, and characters of a piece of a long word.
RUN, WORDS, WIDTH = 16, 8, 24
#: Largest sentence values that a text is judged by.
TOP = 4
#: Characters of one piece of a sentence, and of the sentences that are scored at once.
LONG, PART = 20_000, 400_000
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_BREAK = re.compile(r"[.!?]+(?=\s|$)|[\n\r]+")
_JUNK = re.compile(r"[^\w\s]+|_")
_EMPTY_VALUE = -1.5
_WIDE = re.compile(rf"\S{{{WIDTH + 1},}}")


def _pieces(m: re.Match) -> str:
    return " ".join(m[0][i : i + WIDTH] for i in range(0, len(m[0]) - WIDTH // 2, WIDTH // 2))


def sentences(text: str | None, most: int = LONG) -> list[str]:
    """The sentences of a text: lower case, without punctuation, single spaces; long words and sentences in overlapping pieces."""
    plain = _JUNK.sub("", _BREAK.sub("\n", (text or "").lower()))
    found = [" ".join(s.split()) for s in _WIDE.sub(_pieces, plain).split("\n")]
    return [s[i : i + most].strip() for s in found if s for i in range(0, max(1, len(s) - WIDTH), most - WIDTH)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashed(x: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each reach b, the hashed subsequences x[i], x[i + a], x[i + b] of all a, at each place i of the last axis."""
    n = x.shape[-1] - SPAN + 1
    first, middle, last = (x * f for f in _FACTORS)
    for b in range(2, SPAN):
        ends = last[..., b : b + n] + first[..., :n]
        yield b, [(ends + middle[..., a : a + n]) >> np.uint32(16) for a in range(1, b)]


def _norm(length):
    """The length of the counts of a string of so many characters, were they all of different subsequences."""
    return np.sqrt(sum((b - 1) * DECAY ** (2 * b + 2) * np.maximum(0, length - b) for b in range(2, SPAN)))


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each string, put between spaces, hashed subsequences and their weights."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings)) + 2
    wide = int(lens.max(initial=3))
    x = np.zeros((len(strings), wide + SPAN), np.uint32)
    row = np.repeat(np.arange(len(strings)), lens)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)] = codes("".join(f" {s} " for s in strings))
    place, keys, weights = np.arange(wide + 1), [], []
    for b, found in _hashed(x):
        inside = np.where(place + b < lens[:, None], np.float32(DECAY ** (b + 1)), np.float32(0))
        for h in found:
            keys.append(h.astype(np.int32))
            weights.append(inside)
    return np.concatenate(keys, 1), np.concatenate(weights, 1) / _norm(lens)[:, None].astype(np.float32)


def decide(strings: list[str], model: dict) -> np.ndarray:
    """The machine's value of each string."""
    out = np.empty(len(strings), np.float32)
    order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
    for at in range(0, len(strings), 2000):
        part = order[at : at + 2000]
        k, w = features([strings[i] for i in part])
        out[part] = (model["weights"][k] * w).sum(1) + model["bias"]
    return out


def values(found: list[str], model: dict) -> np.ndarray:
    """The machine's value of each sentence: the largest among its runs of words."""
    if not found:
        return np.zeros(0, np.float32)
    lens = np.fromiter(map(len, found), np.int64, len(found))
    x = codes(" " + "  ".join(found) + " " * SPAN)
    sums = {}
    for b, hashed in _hashed(x):
        own = model["weights"][hashed[0]]
        for h in hashed[1:]:
            own = own + model["weights"][h]
        sums[b] = np.concatenate(([0.0], np.cumsum(own, dtype=np.float64))) * DECAY ** (b + 1)
    blank = np.concatenate(([True], x == 32))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    begins, ends = edge[::2], edge[1::2]
    first = np.searchsorted(begins, np.cumsum(lens + 2) - lens - 1)  # the first word of each sentence
    sentence = np.repeat(np.arange(len(found)), np.diff(np.append(first, len(begins))))

    def of(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        size = e - s + 2
        total = sum(np.where(size > b, c[np.maximum(e - b + 1, 0)] - c[s - 1], 0) for b, c in sums.items())
        return (total / _norm(size)).astype(np.float32)

    best = of(begins, ends)
    for n in range(1, WORDS):
        most = RUN if n == 1 else 2 * n + 1  # two words, or single letters
        run = np.flatnonzero((ends[n:] - begins[:-n] <= most) & (sentence[n:] == sentence[:-n]))
        if not len(run):
            continue
        best[run] = np.maximum(best[run], of(begins[run], ends[run + n]))
    return np.maximum.reduceat(best, first) + np.float32(model["bias"])


def runs(sentence: str) -> list[str]:
    """All runs of words of a sentence."""
    words = sentence.split()
    out = list(words)
    for i in range(len(words)):
        out += [run for n in range(2, WORDS + 1) if i + n <= len(words) and len(run := " ".join(words[i : i + n])) <= (RUN if n == 2 else 2 * n - 1)]
    return out


def _landmarks(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The whitened Nyström map: a row for each bucket that a landmark has, and one of zeros; and those buckets."""
    k, w = features(strings)
    known, at = np.unique(k[w > 0], return_inverse=True)
    base = np.zeros((len(known) + 1, len(strings)), np.float32)
    np.add.at(base, (at, np.nonzero(w > 0)[0]), w[w > 0])
    gram = (base.T @ base).astype(np.float64)
    size, vectors = np.linalg.eigh(gram)
    good = size > 1e-4 * size.max()
    return base @ (vectors[:, good] / np.sqrt(size[good])).astype(np.float32), known


def _mapped(strings: list[str], folded: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The map of strings: kernel values with the landmarks, whitened."""
    place = np.full(BUCKETS, len(known), np.int32)
    place[known] = np.arange(len(known))
    out = np.empty((len(strings), folded.shape[1]), np.float32)
    order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
    for at in range(0, len(strings), 1000):
        part = order[at : at + 1000]
        k, w = features([strings[i] for i in part])
        for i, row, own in zip(part, place[k], w, strict=True):
            use = own > 0
            out[i] = own[use] @ folded[row[use]]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 8) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps, summed over blocks of rows; the last coefficient is the bias."""
    m = x.shape[1]
    w = np.zeros(m + 1)
    penalty = np.append(np.full(m, ridge), 1e-6)
    for _ in range(steps):
        left, right = np.diag(penalty), np.zeros(m + 1)
        for at in range(0, len(x), 4096):
            own, t, v = x[at : at + 4096], y[at : at + 4096], weight[at : at + 4096]
            active = t * (own @ w[:-1] + w[-1]) < 1
            own = np.append(own[active], np.ones((int(active.sum()), 1), x.dtype), 1).astype(np.float64)
            left += (own * v[active, None]).T @ own
            right += own.T @ (v[active] * t[active])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients (the last is the offset) by Newton steps, with Platt's smoothed targets."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * len(y) / 100)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - t)) + penalty * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return w


def altered(word: str, n: int) -> list[str]:
    """The word with a character inserted, one removed, a space inside, and a space after each letter; places follow from n."""
    if len(word) < 4:
        return []
    at = 1 + n % (len(word) - 1)
    return [word[:at] + "abcdeghiklmnorstuxqz01"[(5 * n + at) % 22] + word[at:], word[: at - n % 2] + word[at + 1 - n % 2 :], word[:at] + " " + word[at:], " ".join(word)]


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def fit(rows: list[tuple[int, int, str]], landmarks: int = 800, rounds: int = 4, ridge: float = 0.1, cues: int = 2, negatives: int = 5000, copies: int = 16, doubt: float = 3.0) -> dict | None:
    """Weights and bias from labelled sentences (id, label, sentence); None without both labels. ``cues``: words taken from a text of
    a text; ``copies``: alterations of a word of each kind; ``negatives``: examples of label 0, of each of four kinds; ``doubt``: weight of
    the words that a text of label 0 is judged by."""
    texts: tuple[dict[int, set[str]], dict[int, set[str]]] = ({}, {})
    for ident, y, s in rows:
        texts[y].setdefault(ident, set()).update(s.split())
    if not texts[0] or not texts[1]:
        return None
    clean, toxic = (Counter(w for t in side.values() for w in t) for side in texts)
    odds = {w: float(np.log((n + 0.5) / (len(texts[1]) + 1)) - np.log((clean.get(w, 0) + 0.5) / (len(texts[0]) + 1))) for w, n in toxic.items() if len(w) <= WIDTH}
    value = {w: o * float(np.log1p(toxic[w])) for w, o in odds.items()}
    every = sorted(odds)
    vocabulary = sorted({*every, *(w for w in clean if len(w) <= WIDTH)})
    harmless = sorted({s for _, y, s in rows if y == 0}, key=lambda s: (hash_of(s), s))
    some = sorted((w for w in clean if len(w) <= WIDTH), key=lambda w: (hash_of(w), w))[:negatives]
    common = sorted((w for w in clean if clean[w] > 3 and len(w) <= WIDTH), key=lambda w: (-clean[w], w))[:negatives]
    spread = [each[hash_of(s) % len(each)] for s in harmless[:negatives] if (each := [r for r in runs(s) if " " in r])]
    hard: dict[str, None] = {}
    model: dict = {}
    for nth in range(rounds):
        votes, against = (Counter(w for words in side.values() for w in heapq.nsmallest(cues, (w for w in words if w in value), key=lambda w: (-value[w], w))) for side in (texts[1], texts[0]))
        chosen = [w for w in sorted(votes, key=lambda w: (-votes[w], w)) if odds[w] > 0] or every[:1]
        plus = {w: float(votes[w]) for w in chosen}
        for w in chosen:
            new = {v for n in range(copies) for v in altered(w, n) if v not in clean}
            for v in new:
                plus.setdefault(v, votes[w] * 2 / len(new))
        rest = {w: min(clean.get(w, 1), 20.0) for w in dict.fromkeys([*some, *common, *spread, *hard])}
        share = sum(plus.values()) / sum(rest.values())
        minus = {w: n * share for w, n in rest.items()}
        for w, n in against.items():
            minus[w] = max(minus.get(w, 0.0), n * doubt)
        picked = list(dict.fromkeys([*chosen[: landmarks // 2], *list(hard)[: landmarks // 4], *some]))[:landmarks]
        folded, known = _landmarks(picked)
        y = np.where(np.arange(len(plus) + len(minus)) < len(plus), 1.0, -1.0)
        weight = np.array([*plus.values(), *minus.values()])
        weight *= len(y) / weight.sum()
        v, bias = _svm(_mapped([*plus, *minus], folded, known), y, weight, ridge)
        weights = np.zeros(BUCKETS, np.float32)
        weights[known] = folded[:-1] @ v.astype(np.float32)
        model = {"weights": weights, "bias": bias, "cues": [w for w in chosen if w not in clean and len(w) > 3][:20]}
        if nth + 1 < rounds:
            value = {w: v + 0.2 * min(max(odds.get(w, -4.0), -4.0), 4.0) for w, v in zip(vocabulary, decide(vocabulary, model).tolist(), strict=True)}
            hard = dict.fromkeys([*_worst(harmless, model, negatives), *hard])
    return model


def _worst(found: list[str], model: dict, most: int) -> list[str]:
    """The runs with the largest values, one of a sentence."""
    best = [v for part in _parts(found) for v in values(part, model).tolist()]
    each = [runs(found[i]) for i in heapq.nlargest(most, range(len(found)), key=best.__getitem__)]
    known = list(dict.fromkeys(r for own in each for r in own))
    value = dict(zip(known, decide(known, model).tolist(), strict=True))
    return [max(own, key=value.__getitem__) for own in each]


def _parts(found: Iterable[str], most: int = PART) -> Iterator[list[str]]:
    part, size = [], 0
    for s in found:
        part.append(s)
        size += len(s) + 2
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def evidence(best: list[float], n: int) -> list[float]:
    """What the logistic fit sees of a text: its TOP largest sentence values and the logarithm of its number of sentences (4 at least)."""
    top = heapq.nlargest(TOP, best)
    return top + [_EMPTY_VALUE] * (TOP - len(top)) + [float(np.log1p(max(n, 4)))]


def evidence_of(texts: list[str | None], model: dict) -> np.ndarray:
    """Evidence of each text; a text's sentences are valued in parts, of which the TOP largest stay."""
    best: list[list[float]] = [[] for _ in texts]
    count = [0] * len(texts)

    def each() -> Iterator[str]:
        for i, t in enumerate(texts):
            own = sentences(t)
            count[i] = len(own)
            for s in own:
                owner.append(i)
                yield s

    owner: list[int] = []
    for part in _parts(each()):
        for i, v in zip(owner, values(part, model).tolist(), strict=True):
            heap = best[i]
            if len(heap) < TOP:
                heapq.heappush(heap, v)
            elif v > heap[0]:
                heapq.heapreplace(heap, v)
        owner.clear()
    return np.array([evidence(b, n) for b, n in zip(best, count, strict=True)]).reshape(-1, TOP + 1)


def train(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_texts: int = 2500, max_sentences: int = 40_000, planted: float = 0.2, **how) -> dict:
    """Fits on ``docs`` joined with ``labels``; ``usable`` (a column over the id) says which labels may be learnt. A quarter of the
    texts is kept apart for the logistic fit, which also sees those of label 0 with an altered cue word added, as label 1, of ``planted`` times
    the weight of label 1. The machine is fitted in one task, on the bounded sample."""
    spark = docs.sparkSession
    ship(spark)
    label = F.col(label_col).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("id"), label.alias("y")).where("id is not null and y in (0, 1)")
    if usable is not None:
        known = known.where(usable(F.col("id")))
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_texts) for y in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]).withColumn("apart", F.crc32(F.concat(F.lit("kept "), F.col("id").cast("string"))) % 4 == 0))  # 2 * max_texts ids at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "y", "apart", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = sentences(b.column(2)[i].as_py(), 400)
                for at in range(0, len(own), 10_000):
                    part = own[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(k)[i].as_py()] * len(part), t) for k, t in ((0, pa.int64()), (1, pa.int32()))] + [pa.array(part, pa.string())], names=["id", "y", "sentence"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        model = fit(sorted(rows), **how)
        if model is not None:
            yield pa.RecordBatch.from_pydict({"weights": [model["weights"].tobytes()], "bias": [model["bias"]], "cues": pa.array([model["cues"]], pa.list_(pa.string()))})

    said = texts.where("not apart").select("id", "y", "text").mapInArrow(lean(cut), "id long, y int, sentence string")
    sample = [said.where(F.col("y") == y).orderBy(F.xxhash64("sentence", "id"), "id").limit(max_sentences) for y in (0, 1)]
    found = sample[0].union(sample[1]).repartition(1).mapInArrow(lean(learn), "weights binary, bias double, cues array<string>").first()  # 2 * max_sentences rows of 400 characters at most
    if found is None:
        ones, every = known.agg(F.count_if(F.col("y") == 1), F.count("*")).first()
        share = (ones / every if every else 0.0) * (1 - 2e-9) + 1e-9
        return {"weights": np.zeros(BUCKETS, np.float32), "bias": 0.0, "logit": np.array([0.0] * (TOP + 1) + [np.log(share / (1 - share))])}
    model = {"weights": np.frombuffer(found.weights, np.float32), "bias": found.bias}
    shared, cues = spark.sparkContext.broadcast(dict(model)), list(found.cues)  # tables of fixed size

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, y = b.column(3).to_pylist(), b.column(1).to_pylist()
            kind = [*y, *([2] * y.count(0) if cues else [])]
            for i, t in enumerate(list(said)) if cues else ():
                n = hash_of(f"planted {b.column(0)[i].as_py()}")
                if y[i] == 0:
                    word = cues[n % len(cues)]
                    said.append(f"{t or ''} {altered(word, n // 64)[n // 20 % 3]}")
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(list(evidence_of(said, shared.value)), pa.list_(pa.float64()))], names=["kind", "x"])

    some = texts.where("apart")
    if some.agg(F.countDistinct("y")).first()[0] < 2:
        some = texts
    seen = some.mapInArrow(lean(weigh), "kind int, x array<double>").toArrow().to_pylist()  # 4 * max_texts rows of a few numbers
    shared.unpersist()
    seen.sort(key=lambda r: (r["kind"], r["x"]))
    kind = np.array([r["kind"] for r in seen])
    weight = np.where(kind == 2, planted * (kind == 1).sum() / max(1, (kind == 2).sum()), 1.0)
    model["logit"] = _logistic(np.array([r["x"] for r in seen]), (kind > 0).astype(np.float64), weight)
    return model


def scorer(model: dict):
    """A function from a list of texts to their scores."""

    def run(texts: list[str | None]) -> np.ndarray:
        x = evidence_of(texts, model)
        return 1 / (1 + np.exp(-np.clip(x @ model["logit"][:-1] + model["logit"][-1], -30, 30)))

    return run


def _slices(column: pa.Array, most: int = 256) -> Iterator[list[str | None]]:
    for at in range(0, len(column), most):
        yield column.slice(at, most).to_pylist()


def _sent(docs: DataFrame, model: dict):
    ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("weights", "bias", "logit")})  # tables of fixed size


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(shared.value)
        for b in batches:
            scores = np.concatenate([of(x) for x in _slices(b.column(1))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def held_out(ident):
    return F.coalesce(F.crc32(ident.cast("string")) % 4 == 2, F.lit(False))


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay as they are."""
    shared, at = _sent(docs, train(docs, labels, lambda i: ~held_out(i), text_col=text_col, **how)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(shared.value)
        for b in batches:
            scores = np.concatenate([of(x) for x in _slices(b.column(at))] or [np.zeros(0)])
            yield b.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
