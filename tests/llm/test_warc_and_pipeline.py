"""Archives and the pipeline."""

import gzip
import hashlib

from junctura.llm import warc


def test_chunked_framing_round_trip():
    for payload in (b"", b"x", b"\r\n0\r\n\r\n" * 50, bytes(range(256)) * 100):
        for size in (1, 7, 4096):
            assert warc.dechunked(warc.chunked(payload, size)) == payload
    assert warc.dechunked(b"5\r\nab") is None and warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"") is None


def test_parse_reads_plain_and_gzip_of_many_members():
    records = warc.records_of(1, "http://a b\n", b"x" * 50_000, hashlib.sha256(b"x" * 50_000).hexdigest(), None) + warc.records_of(2, None, b"\r\n\r\nWARC/1.1\r\n\r\n", "d", None)
    plain = b"".join(r + b"\r\n\r\n" for r in records)
    members = b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)
    for content in (plain, gzip.compress(plain), members):
        got = list(warc.parse(content))
        assert len(got) == len(records) and got[-1][1].endswith(b"0\r\n\r\n")
    assert list(warc.parse(b"")) == []


def test_round_trip_with_revisits_and_segments(spark, tmp_path):
    big = "é" * 40_000
    rows = [(1, "http://a b\r\n", None), (2, None, "x" * 99), (3, None, "x" * 99), (4, "u", big), (9, "u", big), (9, "u", big), (4, "u", big), (None, "u", big), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (6, "", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    named = lambda r: r.record_id.split(":")[2].rstrip(">")
    responses = sorted((named(r), bytes(r.payload).decode()) for r in got if r.record_type == "response")
    assert responses == sorted((str(i) if i is not None else "none", h or "") for i, _, h in rows if i != 9)
    assert [(named(r), r.refers_to, r.payload_digest) for r in got if r.record_type == "revisit"] == [("9", "<urn:page:4>", hashlib.sha256(big.encode()).hexdigest())] * 2


def test_missing_segment_is_not_complete(spark, tmp_path):
    payload = bytes(i % 251 for i in range(60_000))
    records = warc.records_of(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)
    assert len(records) > 3
    for k, kept in enumerate((records, records[:-1], records[:1] + records[2:], records[::-1])):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.warc.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in kept)))
        got = [r for r in warc.read(spark, str(tmp_path / str(k))).collect() if r.record_type]
        assert [r.complete for r in got] == [k in (0, 3)] and (bytes(got[0].payload) == payload if k in (0, 3) else got[0].payload is None)


def test_empty_archive(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    import corpus_pipeline
    from test_texts import toxic_corpus

    rows = toxic_corpus(300)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    docs += [(1000 + i, docs[1][1], "en", "s0", 9) for i in range(5)] + [(2000, None, None, None, None), (2001, "", "en", None, 0), (2002, "mail me a@b.org the re tion an", "en", "s1", 31), (2002, "mail me a@b.org the re tion an", "en", "s1", 31)]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, size int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == frame.columns
        counts.append(after.count())
        if name == "near_duplicates":
            ids = [r.doc_id for r in after.collect()]
            assert len(ids) == len(set(ids)) and 1000 not in ids and 2002 in ids
        if name == "pii":
            assert [r.text for r in after.where("doc_id = 2002").collect()] == ["mail me [EMAIL] the re tion an"]
        frame = after
    assert counts[0] < len(docs) and counts[1] < counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    assert frame.where("not round_trip").count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, frame.select("doc_id", "ids_sha256").collect()))


