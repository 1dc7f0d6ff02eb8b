import base64
import glob
import gzip
import hashlib
import io
import struct

import numpy as np
import pytest
import zstandard
from pyspark.errors import PythonException

from quizloom.llm import warc

PAGE = "page_id long, url string, html string"


def rows_of(data, window=64):
    return list(warc.records_in(io.BytesIO(data), "a", window))


def plain(pages):
    """Per page: page_id, payload bytes, digest, type and what a revisit refers to."""
    last = {}
    for page, _, html in pages:
        key = (html or "").encode()
        last[key] = max(last.get(key, -1), -1 if page is None else page)
    done, out = set(), []
    for page, _, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        best = None if last[body] == -1 else last[body]
        if page == best and body not in done:
            done.add(body)
            out.append((page, len(body), digest, "response", None))
        else:
            out.append((page, len(body), digest, "revisit", best))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, v) for v in r])


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, "ü" * 70_000), (4, "", None), (None, "http://n/", ""), (6, "http://c/ d\r\nWARC-Type: warcinfo", "<p>only</p>"), (7, "é", "\r\n\r\nWARC/1.1\r\n"), (2, "http://b/", "<p>x</p>"), (None, None, None)]


def test_what_was_written_is_read(spark, tmp_path):
    pages = PAGES + [(100 + i, f"http://h/{i}", "copy of a page " * 20) for i in range(400)]
    df = spark.createDataFrame(pages, PAGE).repartition(4)
    assert ordered(warc.report(df, f"file://{tmp_path}/a").collect()) == ordered(plain(pages))
    found = warc.read(spark, f"file://{tmp_path}/a")
    payloads = {(r.record_id.split(":")[2], bytes(r.payload)) for r in warc.resolved(found).collect()}
    assert payloads == {("" if p is None else str(p), (h or "").encode()) for p, _, h in pages}
    uris = {r.target_uri for r in found.collect() if r.target_uri}
    assert "http://c/%20d%0D%0AWARC-Type:%20warcinfo" in uris and "%C3%A9" in uris
    assert found.filter("problem is not null").isEmpty() and found.filter("record_type = 'warcinfo'").count() >= 1


def test_an_archive_has_its_dictionary_in_front_and_a_frame_a_record(spark, tmp_path):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(400)]
    pages = [(i, f"http://h/{i}", "<html><body>" + " ".join(rng.choice(vocabulary, 120)) + "</body></html>") for i in range(300)]
    df = spark.createDataFrame(pages, PAGE).coalesce(1)
    dictionary = warc.train(df)
    assert dictionary and dictionary == warc.train(df.repartition(3))  # the same from any layout
    warc.write(df, f"file://{tmp_path}/a")
    files = glob.glob(f"{tmp_path}/a/*.warc.zst")
    data = open(files[0], "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and warc.dictionary_in(memoryview(data)[: 8 + size]).as_bytes() == dictionary
    found = warc.read(spark, f"file://{tmp_path}/a").filter(f"archive = '{files[0].rpartition('/')[2]}'").collect()
    codec, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), 8 + size
    for r in sorted(found, key=lambda r: r.offset):  # any other reader of frames finds one record in each
        assert r.offset == at
        raw = codec.decompressobj().decompress(data[at : at + r.frame_bytes])
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Record-ID") == 1
        at += r.frame_bytes
    assert at == len(data)


def archive(records, dictionary=None, **options):
    codec = zstandard.ZstdCompressor(write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}), **options)
    return (warc.dictionary_frame(dictionary) if dictionary else b"") + b"".join(codec.compress(r) for r in records)


def good(i=1, payload=b"hello"):
    return warc.response(f"urn:page:{i}:0", f"http://x/{i}", "2020-01-01T00:00:00Z", payload, warc.digest_of(payload))


BROKEN = {
    "version line": lambda r: r.replace(b"WARC/1.1", b"WARC/9.1"),
    "block of": lambda r: r.replace(b"\r\n\r\nHTTP", b"\r\n\r\nHTTP!"),
    "Content-Length": lambda r: r.replace(b"Content-Length: " + str(len(warc.http_head(5)) + 5).encode(), b"Content-Length: -1"),
    "without warc-record-id": lambda r: r.replace(b"WARC-Record-ID", b"X-Record-ID"),
    "without warc-date": lambda r: r.replace(b"WARC-Date: 2020-01-01T00:00:00Z", b"WARC-Date: "),
    "without warc-target-uri": lambda r: r.replace(b"WARC-Target-URI", b"X-Target-URI"),
    "no two line ends": lambda r: r[:-4] + b"\n\n\n\n",
    "block digest differs": lambda r: r.replace(b"hello", b"hallo"),
    "have no end": lambda r: b"WARC/1.1\r\nWARC-Type: response\r\n",
    "without a name": lambda r: r.replace(b"WARC-Date", b"no colon\r\nWARC-Date"),
    "is repeated": lambda r: r.replace(b"WARC-Date", b"WARC-Date: 2021-01-01T00:00:00Z\r\nWARC-Date"),
    "not UTF-8": lambda r: r.replace(b"http://x/1", b"http://x/\xff"),
    "payload digest differs": lambda r: r.replace(b"WARC-Payload-Digest: sha1:" + warc.digest_of(b"hello").encode(), b"WARC-Payload-Digest: sha1:" + warc.digest_of(b"other").encode()),
    "digest is": lambda r: r.replace(b"Block-Digest: sha1:", b"Block-Digest: md5:"),
}


@pytest.mark.parametrize("problem", BROKEN)
def test_a_broken_record_is_told_and_the_next_one_read(problem):
    found = rows_of(archive([good(0), BROKEN[problem](good()), good(2)]))
    assert [bool(r.get("problem")) for r in found] == [False, True, False] and problem in found[1]["problem"]
    assert [r.get("record_id") for r in found] == ["urn:page:0:0", None, "urn:page:2:0"]


def test_http_length_is_checked():
    block = warc.http_head(7) + b"hello"
    wrong = warc.record("response", "urn:x", "2020-01-01T00:00:00Z", block, [("WARC-Target-URI", "http://x/")], "application/http; msgtype=response")
    assert "HTTP Content-Length 7" in rows_of(archive([wrong]))[0]["problem"]


def test_broken_frames():
    data = archive([good(i, b"payload %d " % i * 50) for i in range(5)])
    sizes = [r["frame_bytes"] for r in rows_of(data)]
    cut = rows_of(data[: sum(sizes[:3]) + 20])
    assert [r.get("problem") for r in cut] == [None] * 3 + ["the archive ends inside a frame"]
    flipped = bytearray(data)
    flipped[sum(sizes[:2]) - 2] ^= 0xFF  # in the checksum of the second
    assert [bool(r.get("problem")) for r in rows_of(bytes(flipped))] == [False, True, False, False, False]
    flipped = bytearray(data)
    flipped[sizes[0]] ^= 0xFF  # the magic number of the second: no later frame can be found
    assert [bool(r.get("problem")) for r in rows_of(bytes(flipped))] == [False, True]
    assert "no frame begins here" in rows_of(gzip.compress(b"x"))[0]["problem"]
    assert rows_of(b"") == []


def test_archives_of_other_writers():
    samples = [good(i, bytes(np.random.default_rng(i).integers(97, 110, 300, np.uint8))) for i in range(200)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    for data in (
        archive(samples),
        archive(samples, dictionary),
        archive(samples, write_content_size=False),
        struct.pack("<II", 0x184D2A5D, len(dictionary)) + dictionary + archive(samples, dictionary)[len(warc.dictionary_frame(dictionary)) :],  # not compressed
        archive(samples[:100]) + struct.pack("<II", 0x184D2A51, 3) + b"abc" + archive(samples[100:]),  # something to skip
    ):
        for window in (16, 1000, 1 << 20):
            found = rows_of(data, window)
            assert len(found) == 200 and not any(r.get("problem") for r in found)
            assert [r["payload"] for r in found] == [s.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4] for s in samples]
    without = archive(samples, dictionary)[len(warc.dictionary_frame(dictionary)) :]
    assert all("frame" in r["problem"] for r in rows_of(without))
    folded = good().replace(b"WARC-Date: 2020-01-01T00:00:00Z", b"warc-date:\r\n 2020-01-01T00:00:00Z").replace(b"WARC/1.1", b"WARC/1.0")
    assert rows_of(archive([folded]))[0]["date"] == "2020-01-01T00:00:00Z"
    stream = zstandard.ZstdCompressor().compressobj()
    many_blocks = stream.compress(good(1, b"q" * 700_000)) + stream.flush()
    assert rows_of(many_blocks)[0]["payload_bytes"] == 700_000


def test_modes_of_reading(spark, tmp_path):
    (tmp_path / "x.warc.zst").write_bytes(archive([good(0), good(1).replace(b"hello", b"hallo"), good(2)]))
    lenient = warc.read(spark, f"file://{tmp_path}", mode="permissive").orderBy("offset").collect()
    assert [r.problem for r in lenient] == [None, "block digest differs", None]
    assert warc.read(spark, f"file://{tmp_path}/x.warc.zst", mode="permissive", payload=False).filter("payload is null").count() == 3
    with pytest.raises(PythonException, match="block digest differs"):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_only_committed_archives_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    df = spark.createDataFrame(PAGES, PAGE)
    warc.write(df, path)
    first = warc.read(spark, path).filter("record_type <> 'warcinfo'").count()
    (tmp_path / "a" / "part-lost.warc.zst").write_bytes(b"what a lost attempt left")
    assert warc.read(spark, path).filter("record_type <> 'warcinfo'").count() == first == len(PAGES)
    warc.write(df, path)
    assert warc.read(spark, path).filter("record_type <> 'warcinfo'").count() == 2 * first
    warc.write(df, path, mode="overwrite")
    assert warc.read(spark, path).filter("record_type <> 'warcinfo'").count() == first


def test_small_payloads_may_stay_whole(spark, tmp_path):
    warc.write(spark.createDataFrame(PAGES, PAGE), f"file://{tmp_path}/a", least_bytes=100)
    assert warc.read(spark, f"file://{tmp_path}/a").filter("record_type = 'revisit'").isEmpty()


def test_a_revisit_without_its_response(spark, tmp_path):
    lost = warc.revisit("urn:page:1:0", "urn:page:9:9", "http://x/", "2020-01-01T00:00:00Z", 5, warc.digest_of(b"hello"))
    other = warc.revisit("urn:page:3:0", "urn:page:2:0", "http://x/", "2020-01-01T00:00:00Z", 5, warc.digest_of(b"hallo"))
    (tmp_path / "x.warc.zst").write_bytes(archive([lost, good(2), other]))
    got = {r.record_id: r.problem for r in warc.resolved(warc.read(spark, f"file://{tmp_path}")).collect()}
    assert got == {"urn:page:1:0": "the response is missing", "urn:page:2:0": None, "urn:page:3:0": "the response has another digest"}


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame(PAGES, PAGE)
    assert warc.report(df.limit(0), f"file://{tmp_path}/none").count() == 0
    wide = df.selectExpr("*", "1 key", "2 identity", "3 frame", "4 first_key", "5 _salt", "6 payload_bytes")
    assert ordered(warc.report(wide, f"file://{tmp_path}/wide").collect()) == ordered(plain(PAGES))
