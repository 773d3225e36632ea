"""BAM files in pieces: every record once and in order, whatever the pieces' size."""

import io
import random
import struct
import zlib

import pytest

from junctura.sources import bam


def block(part: bytes) -> bytes:
    packed = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packed.compress(part) + packed.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def record(r: random.Random, i: int, length: int) -> bytes:
    name = f"read{i}".encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", r.randrange(-1, 3), r.randrange(10**6), len(name), 60, 0, 1, r.choice([0, 16]), length, -1, -1, 0) + name + struct.pack("<I", length << 4)
    body += r.randbytes((length + 1) // 2) + (b"\x1f\x8b\x08\x04" * length)[:length] + b"NMC\x02"
    return struct.pack("<i", len(body)) + body


def bam_file(seed: int, count: int, aligned: bool) -> bytes:
    r = random.Random(seed)
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 3) + b"".join(struct.pack("<i", 5) + b"chr%d\0" % n + struct.pack("<i", 10**6) for n in range(3))
    parts = [record(r, i, 90_000 if i == count // 2 else r.randrange(0, 300)) for i in range(count)]
    if aligned:  # blocks begin with records, but for a record of several blocks
        out, own = block(head), b""
        for p in parts:
            if own and len(own) + len(p) > 3000:
                out, own = out + b"".join(block(own[k : k + 60_000]) for k in range(0, len(own), 60_000)), b""
            own += p
        out += b"".join(block(own[k : k + 60_000]) for k in range(0, len(own), 60_000))
    else:
        data, out, at = head + b"".join(parts), b"", 0
        while at < len(data):
            n = r.choice([7, 500, 3000, 9000])
            out, at = out + block(data[at : at + n]), at + n
    return out + block(b"")


@pytest.mark.parametrize("aligned", [True, False])
def test_pieces_of_any_size_hold_each_record_once(aligned):
    data = bam_file(5, 600, aligned)
    whole = [r[1:] for r in bam.records(io.BytesIO(data))]
    assert [r[0] for r in whole] == [f"read{i}" for i in range(600)]
    for step in (1009, 20_011, 70_001, len(data), 10**9):
        got = [r[1:] for at in range(0, len(data), step) for r in bam.records(io.BytesIO(data), at, min(at + step, len(data)), len(data))]
        assert got == whole, step


def test_files_without_records_and_broken_files():
    empty = bam_file(1, 0, True)
    assert list(bam.records(io.BytesIO(empty))) == [] and list(bam.records(io.BytesIO(empty), 0, 40, len(empty))) == []
    with pytest.raises(ValueError):
        list(bam.records(io.BytesIO(b"plain text, no blocks")))
    cut_short = block(b"BAM\1" + struct.pack("<ii", 0, 0) + struct.pack("<i", 400) + b"x")
    with pytest.raises(ValueError):
        list(bam.records(io.BytesIO(cut_short)))


def test_source_in_pieces(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.bam").write_bytes(bam_file(k, 300, k == 0))
    spark.dataSource.register(bam.BamDataSource)
    df = spark.read.format("bam").option("split_bytes", 9000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 4
    rows = df.select("seq_no", "query").orderBy("seq_no").collect()
    assert [r["query"] for r in rows] == [f"read{i}" for i in range(300)] * 2 and len({r["seq_no"] for r in rows}) == 600
