"""Operator 13: WARC archives of Zstandard frames with a shared dictionary, written and read by Spark.

An archive begins with a skippable frame that holds the dictionary (itself compressed where that is shorter); then every WARC
record is one frame, so a reader can begin at any record's offset. The reader finds the end of a frame by
walking its block headers, decodes exactly that frame with the dictionary, and validates it: checksum, version
line, header syntax, the required headers of its type, the block's length against Content-Length, the two line ends
behind it, block and payload digests, and the length that the HTTP headers state. mode "failfast" raises at the first broken record; mode "permissive" gives it a row
with its problem and goes on behind it (where the frame's own structure is broken, the rest of the
archive is one such row).

Writing. A first pass turns each page into its digests and its finished response frame, so that what is shuffled
later is compressed. The record of a payload is decided by a grouped maximum of (page_id, row key) per
identity, which Spark adds up before it shuffles; an identity that very many rows share is dealt over
salted tasks for the join. Rows become response frames as they are, or a small revisit record that states the full payload's digest and
length and refers to the response. Both sides are a Spark data source: a task writes archives of
its own, under names that no other attempt has, and only files of successful attempts reach the manifest that the driver commits.

Null payloads are empty; a null url becomes a URN of its record; line ends in urls and other characters that no URI holds are
percent-encoded. Repeated rows and repeated page_ids are records of their own: of equal rows that tie, one is the response. A null
page_id is smaller than any other. Payloads of any length are one record each. Further columns are ignored, whatever their
names. An empty table gives archives without records or none, and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import components
from .common import discard, materialize, scratch_root, sliced

#: Fixed: magic numbers of the Zstandard and WARC-Zstandard formats.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
LEVEL, DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 6, 112_640, 2_000, 16_384
ARCHIVE_BYTES = 256 << 20
#: Fixed: headers that a record of any type must have.
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
NEEDS = {"response": ("warc-target-uri",), "revisit": ("warc-target-uri", "warc-profile", "warc-payload-digest")}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URI_SAFE = "!#$%&'()*+,/:;=?@[]~-._"
RECORDS = "archive string, offset long, frame_bytes long, record_type string, record_id string, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, payload binary, problem string"
ROWS = "key long, page_id long, url string, identity binary, payload_digest string, payload_bytes long, frame binary"


# ---------------------------------------------------------------- one record


class Broken(ValueError):
    """A record that breaks the format; the text says how."""


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri(url: str | None, record_id: str) -> str:
    return quote(url, safe=URI_SAFE) if url else record_id


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record(kind: str, record_id: str, date: str, block: bytes, headers: list[tuple[str, str]], content: str) -> bytes:
    own = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *headers, ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own).encode() + b"\r\n" + block + b"\r\n\r\n"


def response(record_id: str, url: str | None, date: str, payload: bytes, digest: str) -> bytes:
    headers = [("WARC-Target-URI", uri(url, record_id)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    return record("response", record_id, date, http_head(len(payload)) + payload, headers, "application/http; msgtype=response")


def revisit(record_id: str, refers_to: str, url: str | None, date: str, payload_bytes: int, digest: str) -> bytes:
    headers = [("WARC-Target-URI", uri(url, record_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    return record("revisit", record_id, date, http_head(payload_bytes), headers, "application/http; msgtype=response")


def headers_of(raw: bytes, what: str) -> tuple[str, dict[str, str], int]:
    """First line, headers by lower-case name and the length of all of it, for the header part of a WARC record or of an HTTP message."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Broken(f"{what} headers have no end")
    try:
        first, *lines = raw[:end].decode().split("\r\n")
    except UnicodeDecodeError:
        raise Broken(f"{what} headers are not UTF-8") from None
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # a folded line goes on
            found[name] = f"{found[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.lower()
        if not colon or not name or name != name.strip():
            raise Broken(f"{what} header without a name: {line[:60]!r}")
        if name in found and name in (*REQUIRED, "warc-payload-digest", "warc-refers-to", "warc-target-uri", "warc-block-digest"):
            raise Broken(f"{what} header {name} is repeated")
        found[name] = value.strip()
    return first, found, end + 4


def length_of(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise Broken(f"{what} Content-Length is {value!r}")
    return int(value)


def bare(digest: str, what: str) -> str:
    scheme, _, value = digest.partition(":")
    if scheme.lower() != "sha1" or not value:
        raise Broken(f"{what} digest is {digest[:60]!r}")
    return value.upper()


def parsed(raw: bytes) -> dict:
    """The fields of RECORDS that one decoded record gives; raises Broken."""
    version, headers, start = headers_of(raw, "record")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise Broken(f"version line is {version[:40]!r}")
    kind = headers.get("warc-type", "")
    if missing := [h for h in (*REQUIRED, *NEEDS.get(kind, ())) if not headers.get(h)]:
        raise Broken(f"{kind or 'untyped'} record without {missing[0]}")
    size = length_of(headers, "record")
    if len(raw) != start + size + 4:
        raise Broken(f"block of {len(raw) - start - 4} bytes, Content-Length {size}")
    if raw[-4:] != b"\r\n\r\n":
        raise Broken("no two line ends behind the block")
    block = raw[start:-4]
    if "warc-block-digest" in headers and bare(headers["warc-block-digest"], "block") != digest_of(block):
        raise Broken("block digest differs")
    out = {"record_type": kind, "record_id": headers["warc-record-id"].strip("<>"), "refers_to": headers.get("warc-refers-to", "").strip("<>") or None, "target_uri": headers.get("warc-target-uri"), "date": headers["warc-date"]}
    payload, stated = block, None
    if headers.get("content-type", "").startswith("application/http"):
        _, message, body = headers_of(block, "HTTP")
        payload, stated = block[body:], length_of(message, "HTTP") if "content-length" in message else None
    digest = bare(headers["warc-payload-digest"], "payload") if "warc-payload-digest" in headers else None
    if kind == "revisit":
        return out | {"payload_bytes": stated, "payload_digest": digest, "payload": None}
    if stated is not None and stated != len(payload):
        raise Broken(f"payload of {len(payload)} bytes, HTTP Content-Length {stated}")
    own = digest_of(payload)
    if digest is not None and digest != own:
        raise Broken("payload digest differs")
    return out | {"payload_bytes": len(payload), "payload_digest": own, "payload": payload}


# ---------------------------------------------------------------- frames


def frame_length(data: memoryview, at: int) -> int | None:
    """Length of the frame that begins at a place, by its block headers; None if it goes on behind the data."""
    have = len(data) - at
    if have < 8:
        return None
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        return 8 + size if have >= 8 + size else None
    if magic != FRAME:
        raise Broken(f"no frame begins here: {magic:08x}")
    flags = data[at + 4]
    single, content, checksum, dictionary = flags >> 5 & 1, flags >> 6, flags >> 2 & 1, flags & 3
    place = at + 5 + (not single) + (0, 1, 2, 4)[dictionary] + ((single, 2, 4, 8)[content])
    while place + 3 <= len(data):
        block = data[place] | data[place + 1] << 8 | data[place + 2] << 16
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise Broken("a block of a reserved type")
        place += 3 + (1 if kind == 1 else size)  # a repeated byte is stored once
        if last:
            place += 4 * checksum
            return place - at if place <= len(data) else None
    return None


def dictionary_frame(data: bytes) -> bytes:
    """The leading skippable frame of an archive."""
    small = zstandard.ZstdCompressor(level=19).compress(data)
    body = small if len(small) < len(data) else data
    return struct.pack("<II", DICTIONARY, len(body)) + body


def dictionary_in(frame: memoryview) -> zstandard.ZstdCompressionDict:
    body = bytes(frame[8:])
    if body[:4] == struct.pack("<I", FRAME):
        body = decoded(body, zstandard.ZstdDecompressor())
    return zstandard.ZstdCompressionDict(body)


def decoded(frame: bytes | memoryview, codec: zstandard.ZstdDecompressor) -> bytes:
    try:
        if zstandard.frame_content_size(frame) >= 0:
            return codec.decompress(frame)
        return codec.decompressobj().decompress(frame)
    except zstandard.ZstdError as e:
        raise Broken(f"frame: {e}") from None


def codec_for(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **known)


def records_in(file, name: str, window: int = 4 << 20) -> Iterator[dict]:
    """All records of an open archive, in order; a window of it and one record are in memory. Rows of broken ones have a problem."""
    codec, buffer, at, base, fresh = zstandard.ZstdDecompressor(), b"", 0, 0, True
    while True:
        view = memoryview(buffer)
        try:
            size = frame_length(view, at) if at < len(buffer) else None
        except Broken as e:
            yield {"archive": name, "offset": base + at, "problem": str(e)}
            return
        if size is None:
            more = file.read(max(window, len(buffer) - at))
            if not more:
                if at < len(buffer):
                    yield {"archive": name, "offset": base + at, "problem": "the archive ends inside a frame"}
                return
            base, buffer, at = base + at, buffer[at:] + more, 0
            continue
        frame, place = view[at : at + size], base + at
        at += size
        first, fresh = fresh, False
        if struct.unpack_from("<I", frame)[0] & 0xFFFFFFF0 == SKIPPABLE:
            if first and struct.unpack_from("<I", frame)[0] == DICTIONARY:
                try:
                    codec = zstandard.ZstdDecompressor(dict_data=dictionary_in(frame))
                except (Broken, zstandard.ZstdError) as e:
                    yield {"archive": name, "offset": place, "problem": f"dictionary: {e}"}
                    return
            continue
        try:
            yield {"archive": name, "offset": place, "frame_bytes": size} | parsed(decoded(frame, codec))
        except Broken as e:
            yield {"archive": name, "offset": place, "frame_bytes": size, "problem": str(e)}


# ---------------------------------------------------------------- the data source


def storage(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


@dataclass
class Written(WriterCommitMessage):
    files: list
    records: int


@dataclass
class Archive(InputPartition):
    path: str


class WarcSource(DataSource):
    """Format "warc_zstd". Options: path; dictionary (base64) and date for writing; mode (failfast, permissive) and payload (false: leave it out) for reading."""

    @classmethod
    def name(cls) -> str:
        return "warc_zstd"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


class WarcWriter(DataSourceArrowWriter):
    """Rows (key, page_id, url, payload_digest, payload_bytes, frame, first_key, first_page) become archives; frame null or a first_key that is another's means a revisit."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        root, date = self.options["path"], self.options["date"]
        dictionary = base64.b64decode(self.options.get("dictionary") or "") or None
        most = int(self.options.get("archive_bytes") or ARCHIVE_BYTES)
        codec = codec_for(dictionary)
        files, records, out, size = [], 0, None, 0
        system, folder = storage(root)
        system.create_dir(folder, recursive=True)

        def opened():
            files.append(f"part-{uuid.uuid4().hex}.warc.zst")
            stream = system.open_output_stream(f"{folder}/{files[-1]}", compression=None)  # frames are made here, not guessed from the name
            head = dictionary_frame(dictionary) if dictionary else b""
            info = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, b"software: quizloom\r\nformat: WARC File Format 1.1\r\n", [("WARC-Filename", files[-1])], "application/warc-fields")
            stream.write(head + codec.compress(info))
            return stream

        try:
            for batch in iterator:
                names = ("key", "page_id", "url", "payload_digest", "payload_bytes", "first_key", "first_page")
                for i, (key, page, url, digest, n, first_key, first_page) in enumerate(zip(*[batch.column(c).to_pylist() for c in names])):
                    if out is None or size >= most:
                        if out is not None:
                            out.close()
                        out, size = opened(), 0
                    if first_key is None or first_key == key:
                        frame = batch.column("frame")[i].as_py()
                    else:
                        frame = codec.compress(revisit(record_name(page, key), record_name(first_page, first_key), url, date, n, digest))
                    out.write(frame)
                    size, records = size + len(frame), records + 1
        finally:
            if out is not None:
                out.close()
        return Written(files, records)

    def commit(self, messages: list) -> None:
        system, folder = storage(self.options["path"])
        system.create_dir(folder, recursive=True)
        before = manifests(system, folder) if self.overwrite else []
        old = [f for m in before for f in listed(system, m)]
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"files": sorted(f for m in done for f in m.files), "records": sum(m.records for m in done)}).encode())
        for path in [*before, *(f"{folder}/{f}" for f in old)]:
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, folder = storage(self.options["path"])
        for m in messages:
            for f in m.files if m is not None else []:
                system.delete_file(f"{folder}/{f}")


def manifests(system: fs.FileSystem, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(i.path for i in found if i.base_name.startswith("_manifest-"))


def listed(system: fs.FileSystem, manifest: str) -> list[str]:
    with system.open_input_stream(manifest) as f:
        return json.loads(f.read())["files"]


class WarcReader(DataSourceReader):
    """An archive is a partition. A folder with manifests has the files that they name; any other folder all of its *.warc.zst; a path may be one archive."""

    def __init__(self, options: dict):
        self.path, self.payload, self.strict = options["path"], options.get("payload", "true").lower() != "false", options.get("mode", "failfast").lower() != "permissive"

    def partitions(self) -> list[Archive]:
        system, folder = storage(self.path)
        if system.get_file_info(folder).is_file:
            return [Archive(folder)]
        if known := manifests(system, folder):
            return [Archive(f"{folder}/{f}") for m in known for f in listed(system, m)]
        return [Archive(i.path) for i in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path) if i.base_name.endswith(".warc.zst")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Archive):  # no archive at all
            return
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in RECORDS.split(", "))])
        system, _ = storage(self.path)
        rows, size = [], 0
        with system.open_input_stream(partition.path, compression=None) as file:
            for found in records_in(file, partition.path.rpartition("/")[2]):
                if self.strict and found.get("problem"):
                    raise Broken(f"{partition.path} at {found['offset']}: {found['problem']}")
                size += len(found.get("payload") or b"")
                if not self.payload:
                    found["payload"] = None
                rows.append(found)
                if len(rows) == 4096 or (self.payload and size >= 8 << 20):
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


# ---------------------------------------------------------------- pages to archives and back


def record_name(page_id: int | None, key: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{key}"


def train(pages: DataFrame, rows: int = SAMPLE_ROWS, most: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary from at most so many payloads, of which the first SAMPLE_BYTES are shown to the trainer; None where there is too little to train on.

    It bears on the size of archives alone, never on what they hold."""
    some = pages.filter("octet_length(html) > 0").select(F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("html"), F.xxhash64("page_id", "html").alias("h"))
    # about twice as many rows as are asked for reach the driver, whatever the number of partitions
    share = min(1.0, 2.0 * rows / max(1, some.count()))
    sample = some.filter(F.col("h") <= int(-(2**63) + share * (2**64 - 1025))).orderBy("h").limit(rows)
    shown = [bytes(r["html"]) for r in sample.collect()]
    if not shown:
        return None
    try:
        return zstandard.train_dictionary(min(most, max(256, sum(map(len, shown)) // 10)), shown).as_bytes()
    except zstandard.ZstdError:
        return None


def frames(pages: DataFrame, dictionary: bytes | None, date: str) -> DataFrame:
    """Every page with its row key, digests and response frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(dictionary)
        for batch in sliced(batches):
            out = []
            for key, page, url, payload in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "url", "html")]):
                digest = digest_of(payload)
                out.append((key, page, url, hashlib.sha256(payload).digest(), digest, len(payload), codec.compress(response(record_name(page, key), url, date, payload, digest))))
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], [c.split(" ")[0] for c in ROWS.split(", ")])

    own = pages.select(F.monotonically_increasing_id().alias("key"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    return own.mapInArrow(run, ROWS)


def decided(rows: DataFrame, least_bytes: int) -> DataFrame:
    """rows with the key and page_id of the record that a repeated payload refers to, its own for that record itself, null for payloads that occur once."""
    shared = rows.filter(F.col("payload_bytes") >= least_bytes)
    firsts = shared.groupBy("identity").agg(F.max(F.struct("page_id", "key")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("identity", F.col("first.key").alias("first_key"), F.col("first.page_id").alias("first_page"))
    # small payloads have no partner: identities of their own spare them the join's skew
    keyed = rows.withColumn("identity", F.when(F.col("payload_bytes") >= least_bytes, F.col("identity")).otherwise(F.sha2(F.col("key").cast("string"), 256).cast("binary")))
    hot = components.heavy(keyed, "identity", rows.count())
    joined = components.dealt(keyed, hot, "identity", "key").join(components.copied(firsts, hot, "identity"), ["identity", "_salt"], "left")
    return joined.select("key", "page_id", "url", "payload_digest", "payload_bytes", "frame", "first_key", "first_page")


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0, dictionary: bytes | None = None, mode: str = "append") -> None:
    """pages (page_id, url, html) as archives in a folder; without a dictionary one is trained on a bounded sample."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    dictionary = dictionary or train(pages)
    rows = materialize(frames(pages, dictionary, date), "frames")
    options = {"date": date, "dictionary": base64.b64encode(dictionary or b"").decode()}
    decided(rows, least_bytes).write.format("warc_zstd").options(**options).mode(mode).save(path)
    discard(rows)


def read(spark: SparkSession, path: str, payload: bool = True, mode: str = "failfast") -> DataFrame:
    """The records of archives (RECORDS)."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc_zstd").option("payload", str(payload).lower()).option("mode", mode).load(path)


def resolved(records: DataFrame) -> DataFrame:
    """Responses, and revisits with the payload of the response that they refer to; a revisit whose response is missing or has another digest keeps a null payload and gets a problem."""
    own = records.filter(F.col("record_type").isin("response", "revisit"))
    given = own.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload"))
    met = own.filter("record_type = 'revisit'").drop("payload", "problem").join(given, "refers_to", "left")
    fits = F.col("payload_digest") == F.col("_digest")
    problem = F.when(F.col("_digest").isNull(), "the response is missing").when(~fits, "the response has another digest")
    told = met.withColumn("payload", F.when(fits, F.col("_payload"))).withColumn("problem", problem).select(records.columns)
    return own.filter("record_type = 'response'").unionByName(told)


def page_of(name: str):
    return F.split_part(F.col(name), F.lit(":"), F.lit(3)).try_cast("long")


def report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages to archives in the shared folder and gives what the archives say of each page."""
    spark = pages.sparkSession
    path = path or f"{scratch_root(spark)}/quizloom/{uuid.uuid4().hex}/archives"
    write(pages, path)
    own = read(spark, path, payload=False).filter(F.col("record_type").isin("response", "revisit"))
    return own.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


#: Base 32 by 5 of the 160 bits at a time.
PAGES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, list_reduce([''] || [lpad(bin(('0x' || h)::INTEGER), 4, '0') for h in string_split(sha1(body), '')], lambda a, b: a || b) AS bits FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INTEGER + 8 * substr(bits, 5 * i + 2, 1)::INTEGER
        + 4 * substr(bits, 5 * i + 3, 1)::INTEGER + 2 * substr(bits, 5 * i + 4, 1)::INTEGER + substr(bits, 5 * i + 5, 1)::INTEGER, 1) for i in range(32)], '') AS payload_digest,
    CASE WHEN row_number() OVER w = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN row_number() OVER w > 1 THEN first_value(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST)
"""
