"""SentencePiece encoding and decoding by suffix-array matching.

For each slice of a batch, the distinct units (a run of spaces with the run of other characters after it; no piece reaches past
one) are concatenated and indexed by a suffix array that is sorted as deep as the longest piece. Every piece of the vocabulary
is found by binary search, which gives the range of suffixes that it starts; these occurrences are the edges of a lattice.
Edges are sorted by position and relaxed from left to right: the model is a BPE model, whose encoding of each prefix has one
last piece, so an edge is the last piece up to its end exactly if BPE would leave it and the last piece up to its start apart.
That is decided by undoing the two pieces' merges, highest rank first. Ids equal those of the library's own encoder.

The vocabulary is read from the model file on the driver and sent to the tasks (its size is fixed by the file).

Defined cases: a null text encodes like an empty one, to no ids; characters that the vocabulary lacks become byte pieces;
U+2581 decodes to a space, as the model cannot tell the two apart; repeated rows each get a row; other columns are ignored; an
empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, table

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters of text that are worked on at once, and units whose ids are remembered.
SLICE, REMEMBERED = 700_000, 120_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _merge(symbols: list[str], rank: dict[str, int]) -> list[tuple[str, str]]:
    """The merges that BPE makes, in order; ``symbols`` is reduced in place."""
    made = []
    while len(symbols) > 1:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            break
        i = best[1]
        made.append((symbols[i], symbols[i + 1]))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return made


def vocabulary(model_file: str | None = None) -> dict:
    """What matching needs of a BPE model with byte fallback: pieces in order of rank, ids, how each piece was merged, and which
    piece two others make."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file or default_model())
    size = m.get_piece_size()
    plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    plain.sort(key=lambda i: (-m.get_score(i), i))
    pieces = [m.id_to_piece(i) for i in plain]
    # Single characters are there from the start, so they rank before all that is merged. Pieces of one score rank by length,
    # as runs of spaces grow from the left one by one.
    order = sorted(range(len(pieces)), key=lambda k: (len(pieces[k]) > 1, -m.get_score(plain[k]), len(pieces[k])))
    pieces, ids = [pieces[k] for k in order], [plain[k] for k in order]
    rank = {p: r for r, p in enumerate(pieces)}
    joins = {p: r for p, r in rank.items() if len(p) > 1}
    left, right, whole = np.arange(len(pieces)), np.arange(len(pieces)), np.ones(len(pieces), bool)
    for r, p in enumerate(pieces):
        if len(p) > 1:
            symbols = list(p)
            made = _merge(symbols, joins)
            whole[r] = symbols == [p] and all(c in rank for c in p)
            if whole[r]:
                left[r], right[r] = rank[made[-1][0]], rank[made[-1][1]]
    pairs = sorted((rank[p[:k]] * len(pieces) + rank[p[k:]], r) for r, p in enumerate(pieces) if len(p) > 1 for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank)
    as_bytes = [m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
    for i in range(size):
        if m.is_byte(i):
            as_bytes[i] = bytes([int(m.id_to_piece(i)[3:-1], 16)])
        elif m.is_control(i) or m.is_unknown(i):
            as_bytes[i] = b""
    return {
        "pieces": pieces,
        "ids": np.array(ids, np.int32),
        "left": left,
        "right": right,
        "whole": whole,
        "pair_keys": np.array([k for k, _ in pairs], np.int64),
        "pair_ranks": np.array([r for _, r in pairs], np.int64),
        "bytes": as_bytes,
        "byte_ids": np.array([next((i for i in range(size) if m.is_byte(i) and as_bytes[i] == bytes([b])), 0) for b in range(256)], np.int32),
    }


class _Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _search(levels: list, grid: np.ndarray, bits: int, per: int, rows: np.ndarray, start: int, length: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of ranks at ``level`` of what starts with characters start to start + length of the pieces ``grid[rows]``."""
    keys, _, size = levels[level]
    if level == 0:
        low = np.zeros(len(rows), np.int64)
        for i in range(per):
            low = (low << bits) | np.where(i < length, grid[rows, min(start + i, grid.shape[1] - 1)], 0)
        free = (np.int64(1) << (bits * (per - np.minimum(length, per)))) - 1
        return np.searchsorted(keys, low), np.searchsorted(keys, low + free, side="right")
    half = per << (level - 1)
    low, high = _search(levels, grid, bits, per, rows, start, np.minimum(length, half), level - 1)
    first, last = low * size, (high - 1) * size + size - 1
    far = length > half
    if far.any():
        l2, h2 = _search(levels, grid, bits, per, rows[far], start + half, length[far] - half, level - 1)
        none = (high[far] <= low[far]) | (h2 <= l2)
        first[far], last[far] = low[far] * size + l2 + 1, np.where(none, -1, low[far] * size + h2)
    return np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")


class Matcher:
    """Encodes and decodes with one vocabulary; it lives in a task."""

    def __init__(self, v: dict):
        self.v, self.n = v, len(v["pieces"])
        self.lengths = np.array([len(p) for p in v["pieces"]], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        self.single = {ord(p): r for r, p in enumerate(v["pieces"]) if len(p) == 1}
        self.long = np.array([r for r, p in enumerate(v["pieces"]) if len(p) > 1 and v["whole"][r]], np.int64)
        # The code points of the pieces that are looked for, and the characters that they are made of.
        self.grid = np.zeros((len(self.long), self.longest), np.uint32)
        for k, r in enumerate(self.long):
            self.grid[k, : self.lengths[r]] = np.frombuffer(v["pieces"][r].encode("utf-32-le"), np.uint32)
        self.made_of = np.unique(self.grid)[1:]
        # Runs of spaces of all lengths up to one have one score, and BPE grows them from the left: only full ones are left of others.
        runs = np.array([len(p) if not p.strip(SPACE) else 0 for p in v["pieces"]], np.int64)
        self.runs, self.full = runs, int(runs.max(initial=0))
        self.known, self.valid = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, bool)
        self.flat_bytes = np.frombuffer(b"".join(v["bytes"]), np.uint8)
        self.byte_lens = np.array([len(b) for b in v["bytes"]], np.int64)
        self.byte_at = np.cumsum(self.byte_lens) - self.byte_lens
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that two pieces make, or a large number."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.v["pair_keys"], key), len(self.v["pair_keys"]) - 1)
        return np.where(self.v["pair_keys"][at] == key, self.v["pair_ranks"][at], 1 << 62)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves piece b after piece a as they are."""
        left, right = self.v["left"], self.v["right"]
        spaces = (self.runs[a] > 0) & (self.runs[b] > 0)
        out, todo = ~spaces | (self.runs[a] == self.full), np.flatnonzero(~spaces)
        a, b, limit = a[todo], b[todo], np.full(len(todo), 1 << 41)
        while len(todo):
            bad = self._joined(a, b) < limit
            out[todo[bad]] = False
            todo, a, b, limit = todo[~bad], a[~bad], b[~bad], limit[~bad]
            can_a, can_b = right[a] != a, left[b] != b
            undo_a = can_a & ((a > b) | ~can_b)
            undo_b = can_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, right[a], a), np.where(undo_b, left[b], b)
            go = undo_a | undo_b
            todo, a, b, limit = todo[go], a[go], b[go], limit[go]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart``, remembered in a table of fixed size."""
        key = a * self.n + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)
        new = self.known[slot] != key
        out = self.valid[slot]
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            found = self._apart(keys // self.n, keys % self.n)
            out[new] = found[back]
            self.known[slot[new]], self.valid[slot[new]] = key[new], out[new]
        return out

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and rank of every occurrence of a piece of two characters or more in the code points ``text``."""
        alphabet = np.intersect1d(text, self.made_of)
        bits = int(len(alphabet) + 1).bit_length()
        per = min(63 // bits, self.longest)
        n = len(text)
        if not len(alphabet):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)

        def coded(points: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
            return np.where(alphabet[at] == points, at + 1, 0)

        code = np.zeros(n + per, np.int64)
        code[:n] = coded(text)
        key = np.zeros(n, np.int64)
        for i in range(per):
            key = (key << bits) | code[i : n + i]
        table_keys, rank = np.unique(key, return_inverse=True)
        levels = [(table_keys, rank, 1)]  # sorted by per, 2 per, 4 per characters
        while per << (len(levels) - 1) < self.longest:
            _, rank, _ = levels[-1]
            step = per << (len(levels) - 1)
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:] + 1
            size = int(rank.max(initial=0)) + 2
            table_keys, deeper = np.unique(rank * size + ahead, return_inverse=True)
            levels.append((table_keys, deeper, size))
        suffixes = np.argsort(levels[-1][1])

        letters = coded(self.grid)
        usable = np.flatnonzero(((letters > 0) | (self.grid == 0)).all(axis=1))
        lens = self.lengths[self.long[usable]]
        grid = np.zeros((len(usable), -(-self.longest // per) * per), np.int64)
        grid[:, : self.longest] = letters[usable]

        low, high = _search(levels, grid, bits, per, np.arange(len(usable)), 0, lens, len(levels) - 1)
        counts = np.concatenate(([0], np.cumsum(np.bincount(levels[-1][1], minlength=len(levels[-1][0])))))
        first, many = counts[low], np.maximum(counts[np.maximum(high, low)] - counts[low], 0)
        where = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return suffixes[where].astype(np.int32), np.repeat(self.long[usable].astype(np.int32), many)

    def _encode_units(self, units: list[str]) -> None:
        """Appends the ids of new units to the remembered ones."""
        joined = "\0".join(units) + "\0"  # no piece holds U+0000, so none reaches into another unit
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(text)
        alphabet, back = np.unique(text, return_inverse=True)
        unknown = self.n + np.arange(len(alphabet))
        last = np.array([self.single.get(int(c), int(u)) for c, u in zip(alphabet, unknown, strict=True)], np.int64)[back]
        ones = last.copy()
        start, rank = self.edges(text)
        end = start + self.lengths[rank].astype(np.int32)
        # Places that no edge crosses part the text into segments that do not act on each other.
        crossed = np.bincount(start + 1, minlength=n + 2) - np.bincount(end, minlength=n + 2)
        cut = np.flatnonzero(np.cumsum(crossed)[:n] == 0)
        segment = np.zeros(n + 1, np.int64)
        segment[cut] = cut
        segment = np.maximum.accumulate(segment)
        # Single characters are edges too; where one is the whole segment it stands already.
        inside = np.flatnonzero((segment[:n] != np.arange(n)) & (ones < self.n)).astype(np.int32)
        start, rank = np.concatenate([start, inside]), np.concatenate([rank, ones[inside].astype(np.int32)])
        offset = np.concatenate([end, inside + 1]) - segment[start].astype(np.int32)
        del end
        furthest = int(offset.max(initial=0))
        order = np.argsort(offset.astype(np.uint16) if furthest < 1 << 16 else offset, kind="stable")
        start, rank = start[order], rank[order]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(offset, minlength=furthest + 1)[1:])))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo < hi:
                s, r = start[lo:hi], rank[lo:hi].astype(np.int64)
                first = segment[s] == s
                ok = first.copy()
                rest = ~first
                ok[rest] = self.apart(last[s[rest] - 1], r[rest])
                s, r = s[ok], r[ok]
                last[s + self.lengths[r] - 1] = r
        ends = np.zeros(n, bool)
        at = np.concatenate((cut[1:], [n])) - 1
        begin = cut
        size = np.concatenate((self.lengths, np.ones(len(alphabet), np.int64)))
        while len(at):
            ends[at] = True
            at = at - size[last[at]]
            go = at >= begin
            at, begin = at[go], begin[go]
        # Ranks to ids; what the vocabulary lacks becomes the bytes of its character; separators go.
        kept = ends & ~self._separators(joined, units, n)
        found = last[kept]
        many = np.ones(len(found), np.int64)
        odd = found >= self.n
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in alphabet.tolist()]
        sizes = np.array([len(b) for b in spelled], np.int64)
        many[odd] = sizes[found[odd] - self.n]
        ids = np.repeat(np.where(odd, 0, self.v["ids"][np.minimum(found, self.n - 1)]), many).astype(np.int32)
        place = np.cumsum(many) - many
        for c in np.unique(found[odd] - self.n):
            for k, byte in enumerate(spelled[c]):
                ids[place[found == c + self.n] + k] = self.v["byte_ids"][byte]
        per_char = np.zeros(n, np.int64)
        per_char[kept] = many
        total = np.concatenate(([0], np.cumsum(per_char)))
        lens = np.fromiter(map(len, units), np.int64, len(units))
        stops = np.cumsum(lens + 1) - 1
        begins = stops - lens
        self.starts = np.concatenate((self.starts, len(self.flat) + total[begins]))
        self.lens = np.concatenate((self.lens, total[stops] - total[begins]))
        self.flat = np.concatenate((self.flat, ids))

    @staticmethod
    def _separators(joined: str, units: list[str], n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        out[np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1) - 1] = True
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, and where each text's begin (with the end of the last)."""
        if len(self.index) > REMEMBERED:
            self._forget()
        seen, counts = [], []
        index = self.index
        known = len(index)
        for t in texts:
            units = _UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else []
            seen.append(np.fromiter(map(index.__getitem__, units), np.int64, len(units)))
            counts.append(len(units))
        if len(index) > known:
            new = list(index)[known:]
            self._encode_units(new)
        unit = np.concatenate(seen or [np.zeros(0, np.int64)])
        lens = self.lens[unit]
        upto = np.concatenate(([0], np.cumsum(lens)))
        ids = self.flat[np.repeat(self.starts[unit] - upto[:-1], lens) + np.arange(upto[-1])]
        return ids, upto[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of ids laid out as ``encode`` returns them."""
        lens = self.byte_lens[ids]
        upto = np.concatenate(([0], np.cumsum(lens)))
        raw = self.flat_bytes[np.repeat(self.byte_at[ids] - upto[:-1], lens) + np.arange(upto[-1])].tobytes()
        at = upto[bounds].tolist()
        return [raw[s + (raw[s : s + 1] == b" ") : e] if e > s else b"" for s, e in zip(at, at[1:], strict=False)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    part, size, first = [], 0, 0
    for i in range(len(texts)):
        t = texts[i].as_py()
        part.append(t)
        size += len(t or "")
        if size >= SLICE:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, round_trip) of every row: the ids (left out unless ``with_ids``), their number, the
    digest of their 32-bit little-endian form, and whether decoding gives the text back."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value)
        for b in batches:
            for first, texts in _slices(b.column(1)):
                ids, at = m.encode(texts)
                back = m.decode(ids, at)
                same = [(t or "").replace(SPACE, " ").encode("utf-8", "surrogatepass") == x for t, x in zip(texts, back, strict=True)]
                raw = ids.astype("<i4").tobytes()
                digest = [hashlib.sha256(raw[4 * s : 4 * e]).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = {"doc_id": b.column(0).slice(first, len(texts)), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "round_trip": pa.array(same, pa.bool_())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give an empty text, bytes that are no UTF-8 U+FFFD."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value)
        for b in batches:
            texts = []
            for ids in b.column(1):
                flat = np.asarray(ids.as_py() or [], np.int64)
                texts.append(m.decode(flat, np.array([0, len(flat)]))[0].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(lean(run), "doc_id long, text string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
