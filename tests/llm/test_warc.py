"""WARC archives: read back by an independent reader, round trips, and the query against brute force."""

import base64
import glob
import hashlib
import io
import os
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from mixspark.llm import warc as wc
from mixspark.llm.common import joined
from mixspark.llm.queries import op13_warc

SCHEMA = "page_id long, url string, html string"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frames(data):
    """The dictionary, and each record decompressed alone from where its frame begins."""
    kind, n = struct.unpack("<II", data[:8])
    assert kind == 0x184D2A5D
    words, at, out = data[8:8 + n], 8 + n, []
    while at < len(data):
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if n else None).decompressobj()
        out.append(d.decompress(data[at:]))
        assert d.eof
        at = len(data) - len(d.unused_data)
    return words, out


def expected(rows):
    rows = [(i, (t or "").encode()) for i, _, t in rows]
    least, out, whole = -10**9, [], set()
    for i, p in rows:
        top = max((j for j, q in rows if q == p), key=lambda j: least if j is None else j)
        kind = "response" if i == top and (i, p) not in whole else "revisit"
        if kind == "response":
            whole.add((i, p))
        out.append((i, len(p), sha1(p), kind, top if kind == "revisit" else None))
    return sorted(map(repr, out))


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("row", "page", "payload", "refers", "key", "file", "name"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    return sorted(repr(tuple(r)) for r in op13_warc(spark, str(tmp_path)).collect())


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"http://h/{i}", r.choice(["<p>a</p>", "<p>b</p>", f"<p>{i}</p>", "", None, "x" * i])) for i in range(300)]
    rows += [(1000, None, "ä\r\n\r\n漢 😀"), (1001, "ü\r\nX-Row: 7", "ä\r\n\r\n漢 😀"), (1002, "", "WARC/1.1\r\n\r\n"),
             (None, "u", "only null"), (None, "u", "only null"), (None, "u", "<p>a</p>"), (5, "u", "twice"), (5, "u", "twice"),
             (5, "v", "twice"), (-3, "u", "y" * 3_000_000), (-4, "u", "y" * 3_000_000)]
    rows += [(2000 + i, "same", "hot") for i in range(400)]
    assert run(spark, rows, tmp_path) == expected(rows)


def test_nothing(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_archives_stand_alone(spark):
    r = random.Random(2)
    rows = [(i, f"http://h/{i}%20x", "<html>" + " ".join(r.choice(["one", "two", "three"]) for _ in range(200))) for i in range(500)]
    rows += [(1000 + i, None, rows[i][2]) for i in range(50)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(2)
    archives = wc.write_archives(pages, archive_bytes=100_000).collect()
    assert len(archives) > 3 and sum(a.records for a in archives) == len(rows)
    kinds, raw, size = [], 0, 0
    for a in archives:
        data = open(a.file, "rb").read()
        words, records = frames(data)
        size, raw = size + len(data) - len(words), raw + sum(map(len, records))
        assert len(words) and len(data) == a.bytes and len(records) == a.records + 1
        assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for record in records:
            head, _, rest = record.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert rest.endswith(b"\r\n\r\n") and len(rest) == int(fields["Content-Length"]) + 4
            kinds.append(fields["WARC-Type"])
    assert (kinds.count("response"), kinds.count("revisit")) == (500, 50)
    assert size * 3 < raw  # the dictionary serves: single records of random words compress well
    back = {r.row.split(" ")[1]: r for r in wc.read_archives(spark.createDataFrame(archives)).collect()}
    for i, url, html in rows[:450]:
        got = back[str(i)]
        copy = next((j for j, _, t in rows[500:] if t == html), None)
        assert got.url == url and got.payload == (None if copy else bytearray(html.encode()))
        assert got.refers is None if copy is None else got.refers.endswith(f" {copy}")


def test_unlisted_files_are_not_read(spark):
    archives = wc.write_archives(spark.createDataFrame([(1, "u", "a")], SCHEMA))
    [a] = archives.collect()
    with open(os.path.join(os.path.dirname(a.file), "lost.warc.zst"), "wb") as f:
        f.write(b"half an archive")
    assert len(glob.glob(os.path.dirname(a.file) + "/*.zst")) == 2
    assert wc.read_archives(archives).count() == 1


def test_damage_is_found():
    payload = b"<p>payload</p>" * 20
    good = wc.archive([wc.record("1 1", "u", payload, len(payload), sha1(payload), None)] * 3)
    assert len(list(wc.records_of(io.BytesIO(good), 16))) == 4
    with pytest.raises((zstandard.ZstdError, ValueError)):
        list(wc.records_of(io.BytesIO(good[:-3])))
    with pytest.raises((zstandard.ZstdError, ValueError)):
        list(wc.records_of(io.BytesIO(good[:-20] + bytes([good[-20] ^ 1]) + good[-19:])))
    with pytest.raises(ValueError, match="not what was written"):
        wc._row(*wc.parsed(wc.record("1 1", "u", payload, len(payload), sha1(b"other"), None)), True)


def test_frequent_keys_are_joined_whole(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(1500)], "key string, i long")
    table = rows.groupBy("key").agg(F.count("*").alias("times"))
    got = joined(rows, table, "key", "times")
    assert got.count() == 4500 and got.where("times = 3000").count() == 3000
