"""Reading frames of one sequence as plain functions, linear in its length; for Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .sequences import AMINO_ACIDS

_NUMBER = np.full(256, 4, np.uint8)
for _i, _c in enumerate("TCAG"):
    _NUMBER[[ord(_c), ord(_c.lower())]] = _i
_AMINO = np.full(125, ord("X"), np.uint8)
for _n, _a in enumerate(AMINO_ACIDS):
    _AMINO[25 * (_n // 16) + 5 * (_n // 4 % 4) + _n % 4] = ord(_a)
#: T and A, C and G; 4 stands for any other character.
_OTHER = np.array([2, 3, 0, 1, 4], np.uint8)


def six_frames(seq: str) -> Iterator[tuple[str, int, str]]:
    """(strand, frame, amino acids of the whole codons), as ``sequences.translate_codons`` gives them."""
    forward = _NUMBER[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    for strand, numbers in (("+", forward), ("-", _OTHER[forward[::-1]])):
        for frame in range(3):
            whole = max(0, (len(numbers) - frame) // 3)
            codons = numbers[frame : frame + 3 * whole].reshape(whole, 3)
            yield strand, frame, _AMINO[25 * codons[:, 0] + 5 * codons[:, 1] + codons[:, 2]].tobytes().decode("ascii")


def open_frames(seq: str, least: int = 2) -> tuple[int, str | None]:
    """How many stop-free stretches of at least ``least`` amino acids there are, and the first of them in the order of
    ``sequences.open_frames``."""
    found = [(-len(p), strand, frame, p) for strand, frame, aa in six_frames(seq) for p in aa.split("*") if len(p) >= least]
    return len(found), min(found)[3] if found else None
