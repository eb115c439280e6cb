"""WARC archives, each compressed with a Zstandard dictionary of its own.

An archive begins with a skippable frame that holds the dictionary, built from the archive's records, and
each record is a frame of its own. So any record can be read alone, and a reader needs nothing but the
file. Of records with equal payloads one is written whole, the others refer to it.

Tasks write archives into a shared folder. The table of the written files, itself written by Spark, names
those of the attempts that succeeded; whatever a lost task left behind is in no table and never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixspark.llm.common import joined, marked_among, values
from mixspark.sources.scratch import scratch_path, shared_file, stored

#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: Size of a dictionary, and how many times its size of records it is built from.
DICTIONARY_BYTES, SAMPLES = 64 << 10, 50
#: Length of the stretches a dictionary is put together from, and the level of compression.
SEGMENT, LEVEL = 256, 6
#: Bytes read at a time.
READ_BYTES = 1 << 20
#: The type of the leading frame, the profile of records that refer to others, line ends.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LF = "\r\n"
#: The archives' date; they hold copies of a table, which knows no time of retrieval.
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID(int=0)

PLACED = "file string, records bigint, bytes bigint"
READ = "row string, refers string, payload_bytes bigint, payload_digest string, record_type string, " \
    "url string, payload binary"


# ---- records -------------------------------------------------------------------------------------

def sha1_name(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, row)}>"


def _header(fields: dict, content: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None] + [f"Content-Length: {len(content)}"]
    return ("WARC/1.1" + LF + LF.join(lines) + LF + LF).encode()


def one_line(text: str | None, keep: str = "") -> str | None:
    """A value that keeps to its header line: everything outside printable ASCII, and the per cent sign
    unless kept, as per cent escapes of its UTF-8 bytes."""
    if text is None:
        return None
    return "".join(chr(b) if 0x21 <= b <= 0x7E and (b != 0x25 or keep) else f"%{b:02X}" for b in text.encode())


def unescaped(text: str | None) -> str | None:
    return None if text is None else unquote(text)


def record(row: str, url: str | None, payload: bytes, size: int, digest: str, refers: str | None) -> bytes:
    """The bytes of a response record, or of a revisit to the row ``refers``: its HTTP header only."""
    http = ("HTTP/1.1 200 OK" + LF + "Content-Type: text/html; charset=utf-8" + LF
            + f"Content-Length: {size}" + LF + LF).encode()
    content = http if refers is not None else http + payload
    head = _header({
        "WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": record_id(row),
        "WARC-Date": DATE, "WARC-Target-URI": one_line(url, "%"), "X-Row": one_line(row),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": None if refers is None else record_id(refers),
        "X-Refers-To-Row": one_line(refers), "WARC-Profile": None if refers is None else PROFILE,
        "Content-Type": "application/http;msgtype=response",
    }, content)
    return head + content + (LF + LF).encode()


def parsed(data: bytes) -> tuple[dict, bytes]:
    """The header fields and the content of one record."""
    head, _, rest = data.partition((LF + LF).encode())
    first, *lines = head.decode().split(LF)
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]}")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if len(rest) != n + 2 * len(LF) or rest[n:] != (LF + LF).encode():
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has {len(rest)} bytes, {n} are announced")
    return fields, rest[:n]


# ---- archives ------------------------------------------------------------------------------------

def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary built from records spread over the whole archive; from few or short ones, which the
    builder refuses, their beginnings themselves. It only serves compression."""
    total = sum(map(len, records))
    step = max(1, -(-total // (SAMPLES * size)))
    chosen = [r[:size] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), chosen, k=SEGMENT, d=8)
    except zstandard.ZstdError:
        raw = b"".join(chosen)[:size]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def archive(records: list[bytes]) -> bytes:
    """The dictionary's frame, then one frame per record, the first one describing the file."""
    info = _header({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("info"), "WARC-Date": DATE,
                    "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1" + LF.encode())
    info += b"format: WARC File Format 1.1" + 3 * LF.encode()
    words = dictionary(records)
    raw = words.as_bytes() if words else b""
    if words:
        words.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
    frames = [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw]
    frames += [packer.compress(r) for r in [info, *records]]
    return b"".join(frames)


def records_of(source, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The records of an open archive, one by one; memory is bounded by the longest of them."""
    head = source.read(8)
    kind, n = struct.unpack("<II", head)
    if kind != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    raw = source.read(n)
    if len(raw) != n:
        raise ValueError("the archive ends inside its dictionary")
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    words = zstandard.ZstdCompressionDict(
        raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT) if raw else None
    unpacker = zstandard.ZstdDecompressor(dict_data=words)
    data = source.read(read_bytes)
    while data:
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or source.read(read_bytes)
                break
            data = source.read(read_bytes)
            if not data:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


# ---- tables --------------------------------------------------------------------------------------

def row_name(mark: str) -> Column:
    """What the records call a row: a mark, its number and its id, if any."""
    return F.concat_ws(" ", F.concat(F.lit(mark), F.col("row").cast("string")), F.col("page").cast("string"))


def with_originals(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(name, url, payload, refers): ``refers`` names the row that has the same payload and is written
    whole, and is null for that row itself. It is the one of the largest id (null ids rank lowest); of rows
    that repeat the id too, one of them. Only payloads whose digest repeats, and a few others, move."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    repeated = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    rows = marked_among(rows, repeated, "key", repeated.count(), "again")
    number = F.monotonically_increasing_id()
    alone = rows.where("not again").withColumn("row", number).select(
        row_name("a").alias("name"), "url", "payload", F.lit(None).cast("string").alias("refers"))
    # Written once, so the row numbers are the same in every later use.
    copies = stored(rows.where("again").withColumn("row", number), "copies")
    ids = copies.select("key", "row", "page")
    first = ids.groupBy("key").agg(F.max(F.struct("page", "row")).alias("whole"), F.count("*").alias("times"))
    first = stored(first.where("times > 1").select("key", "times", "whole.row", "whole.page"), "originals")
    refers = joined(ids.select("key", F.col("row").alias("copy")), first, "key", "times").where(
        "copy <> row").select(F.col("copy").alias("row"), row_name("c").alias("refers"))
    return alone.unionByName(copies.join(refers, "row", "left").select(
        row_name("c").alias("name"), "url", "payload", "refers"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row and return the table of archives: file, records, bytes.

    A payload is the column's bytes, UTF-8 for text, none for null. Any column may be null; rows may
    repeat, each is a record. An empty table gives no archive. Other columns are not written. Records stay
    in memory until an archive is full; a longer record is an archive's last one."""
    rows = with_originals(pages, id_col, url_col, payload_col)
    folder = scratch_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, url, refers, payload in zip(*(values(batch[c]) for c in ("name", "url", "refers", "payload"))):
                held.append(record(row, url, payload, len(payload), sha1_name(payload), refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    def put(held) -> pa.RecordBatch:
        data, file = archive(held), f"{uuid.uuid4().hex}.warc.zst"
        system, path = shared_file(folder, file)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out:
            out.write(data)
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{file}"]), pa.array([len(held)]), pa.array([len(data)])],
            ["file", "records", "bytes"])

    return stored(rows.mapInArrow(write, PLACED), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the table's archives: row (as written), refers (the row it refers to),
    payload_bytes, payload_digest, record_type, url, payload (null for a revisit, or throughout if not
    wanted). The payload read is compared with the digest in its header."""
    tasks = min(archives.count(), 8 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = archives.repartition(max(1, tasks))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            for file in values(batch["file"]):
                folder, _, name = file.rpartition("/")
                system, path = shared_file(folder, name)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for data in records_of(source):
                        fields, content = parsed(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_row(fields, content, payloads))
                        size += len(rows[-1][-1] or b"") + 200
                        if size >= ARCHIVE_BYTES:
                            yield _rows(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows, names)

    return spread.select("file").mapInArrow(read, READ)


def _row(fields: dict, content: bytes, payloads: bool) -> tuple:
    head, _, payload = content.partition((LF + LF).encode())
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1_name(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
    return (unescaped(fields["X-Row"]), unescaped(fields.get("X-Refers-To-Row")), size, digest, kind,
            fields.get("WARC-Target-URI"), payload if payloads and kind == "response" else None)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def page_of(name: Column, like) -> Column:
    """The id in a record's row name, null where it had none."""
    return F.get(F.split(name, " ", 2), F.lit(1)).cast(like)
