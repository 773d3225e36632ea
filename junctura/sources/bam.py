"""BAM files as a Spark data source: ``spark.dataSource.register(BamDataSource)``, then ``spark.read.format("bam").load(path)``.

A path is a file or a folder, in any store that pyarrow opens. A file is read in pieces of ``split_bytes`` compressed bytes (an option, 128 MB
unless given), each a task that streams its blocks. Blocks and records have no marks of their own, so a piece begins at the first place from which
blocks follow blocks and records follow records; a task works out where its piece and the next one begin, and fails unless its last record ends
exactly there, so no record is lost or read twice.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import ALIGNMENTS

_OPS, _BASES = "MIDNSHPMM", "=ACMGRSVTWYHKDBN"
_SIZES = {b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4, b"A": 1}


_BLOCK = 1 << 16  # the most bytes that a block has, packed or not
_FOLLOW = 16  # records that have to follow each other where a piece begins
_END = (1 << 62, 0)


def _block_size(head: bytes) -> int | None:
    """The size that the header of a BGZF block states, a gzip member; None if ``head`` does not begin with one."""
    if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, stop = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(stop, len(head)):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def blocks(source: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """Offsets and contents of the BGZF blocks from here on."""
    place = source.tell()
    while head := source.read(12):
        if len(head) == 12:
            head += source.read(struct.unpack_from("<H", head, 10)[0])
        size = _block_size(head)
        if size is None:
            raise ValueError("not a BGZF block")
        yield place, zlib.decompress(source.read(size - len(head))[:-8], -15)
        place += size


class _Stream:
    """The unpacked bytes from a block on, and where in the file they lie: (offset of the block, place in it)."""

    def __init__(self, source: BinaryIO, block: int = 0, within: int = 0):
        source.seek(block)
        self.parts, self.buffer, self.at, self.starts = blocks(source), b"", 0, []
        self.read(within)

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.starts = [(n - self.at, b) for n, b in self.starts if n + _BLOCK > self.at]
        self.buffer, self.at = self.buffer[self.at :] + part[1], 0
        self.starts.append((len(self.buffer) - len(part[1]), part[0]))
        return True

    def _fill(self, n: int) -> bool:
        while len(self.buffer) - self.at < n:
            if not self._more():
                return False
        return True

    def read(self, n: int) -> bytes:
        self._fill(n)
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        return out

    def ahead(self, skip: int, n: int) -> bytes:
        self._fill(skip + n)
        return self.buffer[self.at + skip : self.at + skip + n]

    def place(self) -> tuple[int, int]:
        if not self._fill(1):
            return _END
        start, block = max(s for s in self.starts if s[0] <= self.at)
        return block, self.at - start


def _follows(s: _Stream, skip: int, targets: int) -> int | None:
    """The size of the record ``skip`` bytes ahead, 0 at the end of the file; None where there cannot be one."""
    head = s.ahead(skip, 36)
    if not head:
        return 0
    if len(head) < 36:
        return None
    size, ref, pos, lname, _, _, ncigar, _, lseq, mref, mpos, _ = struct.unpack("<iiiBBHHHiiii", head)
    if not (-1 <= ref < targets and -1 <= mref < targets and pos >= -1 and mpos >= -1 and lname > 0 and lseq >= 0 and size >= 32 + lname + 4 * ncigar + (lseq + 1) // 2 + lseq):
        return None
    rest = s.ahead(skip + 36, lname + 4 * ncigar)
    if len(rest) < lname + 4 * ncigar or rest[lname - 1] or not all(33 <= c <= 126 for c in rest[: lname - 1]):
        return None
    return size + 4 if all(v & 15 <= 8 for v in struct.unpack_from(f"<{ncigar}I", rest, lname)) else None


def first_record(source: BinaryIO, at: int, size: int, targets: int) -> tuple[int, int]:
    """The place of the first record that starts in a block at or after the offset ``at`` of a file of ``size`` bytes."""
    source.seek(at)
    window = source.read(3 * _BLOCK)
    place = window.find(b"\x1f\x8b\x08\x04")
    while place >= 0:
        # A block leads to a block, or to the end, as often as the window shows.
        here, good = place, True
        while good and here < min(2 * _BLOCK, size - at):
            n = _block_size(window[here : here + 64])
            good, here = n is not None, here + (n or 0)
        if good and here <= size - at:
            break
        place = window.find(b"\x1f\x8b\x08\x04", place + 1)
    if place < 0:
        return _END
    s = _Stream(source, at + place)
    while s.ahead(0, 1):
        skip, seen = 0, 0
        while seen < _FOLLOW and (n := _follows(s, skip, targets)):
            skip, seen = skip + n, seen + 1
        if seen == _FOLLOW or (seen and n == 0):
            return s.place()
        s.read(1)
    return _END


def _edits(tags: bytes) -> int | None:
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], tags[at + 2 : at + 3]
        at += 3
        if kind in b"ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == b"B":
            at += 5 + _SIZES[tags[at : at + 1]] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            if name == b"NM":
                return struct.unpack_from("<" + {b"c": "b", b"C": "B", b"s": "h", b"S": "H", b"i": "i", b"I": "I"}[kind], tags, at)[0]
            at += _SIZES[kind]
    return None


def records(source: BinaryIO, start: int = 0, stop: int | None = None, size: int | None = None) -> Iterator[tuple]:
    """Rows of the alignments schema, in file order, numbered from 0; of the piece from offset ``start`` to ``stop`` of a file of ``size`` bytes."""
    s = _Stream(source)
    if s.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    s.read(struct.unpack("<i", s.read(4))[0])
    targets = []
    for _ in range(struct.unpack("<i", s.read(4))[0]):
        targets.append(s.read(struct.unpack("<i", s.read(4))[0])[:-1].decode())
        s.read(4)
    first, last = s.place(), _END
    if size is not None and stop is not None and stop < size:
        last = max(first, first_record(source, stop, size, len(targets)))
    if start > 0:
        first = max(first, first_record(source, start, size, len(targets)))
    if first >= last:
        return
    s = _Stream(source, *first)
    name = lambda i: targets[i] if i >= 0 else None
    n = 0
    while (place := s.place()) < last:
        length = struct.unpack("<i", s.read(4))[0]
        r = s.read(length)
        if len(r) < length:
            raise ValueError("the file ends within a record")
        ref, pos, lname, mapq, _, ncigar, flag, lseq, mref, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
        at = 32 + lname
        cigar = [{"op": _OPS[v & 15], "len": v >> 4} for v in struct.unpack_from(f"<{ncigar}I", r, at)]
        at += 4 * ncigar
        packed = r[at : at + (lseq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:lseq]
        at += (lseq + 1) // 2 + lseq
        yield n, r[32 : 31 + lname].decode(), flag, name(ref), pos + 1, mapq, cigar, name(mref), mpos + 1, tlen, seq or None, _edits(r[at:])
        n += 1
    if place != last:
        raise ValueError(f"the next piece begins at {last}, which is within a record; read the file with larger split_bytes")


class _Piece(InputPartition):
    pass


class BamReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(place)) if f.path.endswith(".bam")), key=lambda f: f.path)
        pieces = [(f.path, at, min(at + self.split_bytes, f.size), f.size) for f in found for at in range(0, f.size, self.split_bytes)]
        return [_Piece((n, *p)) for n, p in enumerate(pieces)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        number, place, start, stop, size = partition.value
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(place) as opened:
            for row in records(io.BufferedReader(opened, 1 << 20), start, stop, size):
                yield ((number << 33) + row[0], *row[1:])


class BamDataSource(DataSource):
    """Alignments of BAM files; seq_no follows the order of files and records. Options: path, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options["path"], int(self.options.get("split_bytes", 128 << 20)))
