import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skerry.llm import ogg, queries, warc


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_crc_against_the_definition():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("size", [192, 384, 768, 765 * 192, 192 * 4001])
def test_round_trip(size):
    payload = bytes(i * 31 % 251 for i in range(size))
    media = ogg.encode(payload)
    found = ogg.decode(media)
    assert found["payload"] == payload and found["damaged"] == 0 and found["gaps"] == 0 and found["streams"] == 2
    streams, _, _ = ogg.demultiplex(media)
    assert sum(max(s["ends"]) for s in streams.values()) == size  # granule positions count all samples


def test_damage_and_noise_are_seen():
    payload = bytes(i % 256 for i in range(192 * 900))
    media = bytearray(ogg.encode(payload))
    assert ogg.decode(b"noise" + bytes(media))["payload"] == payload
    media[len(media) // 2] ^= 1
    found = ogg.decode(bytes(media))
    assert found["damaged"] >= 1 and found["gaps"] >= 1 and found["payload"] != payload
    assert ogg.decode(bytes(media[: len(media) // 3]))["damaged"] >= 0
    assert ogg.decode(b"")["pages"] == 0


def test_packet_times_come_from_granule_positions():
    payload = bytes(i % 251 for i in range(192 * 901))
    media = bytearray(ogg.encode(payload))
    frames = [192 * len(range(k, 901, 2)) for k in (0, 1)]
    want = [t / ogg.SAMPLE_RATE for n in frames for t in range(0, n, 768)]
    assert ogg.decode(bytes(media))["starts"] == want
    media[len(media) // 2] ^= 1  # a page is lost: the packets behind it keep their times
    found = ogg.decode(bytes(media))["starts"]
    assert 0 < len(found) < len(want) and set(found) <= set(want) and max(found) == max(want)


def test_op1_contract(spark, tmp_path):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 192), (5, "y" * 5000), (5, "y" * 5000), (None, "z")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op1_ogg_media"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t in rows if i == r["doc_id"])
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(ogg.encode(payload)).hexdigest()


def test_media_keep_columns_that_clash(spark, monkeypatch):
    """Every row comes through, with all its columns, whatever is encoded at a time and whatever names the table has."""
    monkeypatch.setattr(ogg.common.row_groups, "__defaults__", (100,))
    rows = [(i, "t" * (i * 37 % 300), "a", "b", "c", float(i)) for i in range(40)] + [(40, None, "a", "b", "c", 0.0)]
    df = spark.createDataFrame(rows, "id long, text string, media string, N_bytes string, payload string, seconds double")
    written = ogg.write_media(df, [c for c in df.columns if c != "text"])
    assert written.columns == ["id", "media", "N_bytes", "payload", "seconds", "n_bytes_", "media_"]
    read = ogg.read_media(written, "media_")
    assert read.columns[-8:] == ["payload_", "streams", "pages", "packets", "damaged", "gaps", "seconds_", "starts"]
    found = {r["id"]: r for r in read.collect()}
    assert len(found) == len(rows)
    for i, t, media, size, payload, seconds in rows:
        r = found[i]
        assert (r["media"], r["N_bytes"], r["payload"], r["seconds"], r["n_bytes_"]) == (media, size, payload, seconds, len(t or ""))
        assert bytes(r["payload_"]).rstrip(b" ").decode() == (t or "") and r["damaged"] == 0
    assert ogg.read_media(ogg.write_media(df.limit(0), ["id"])).count() == 0


PAGES = "page_id long, url string, html string"


def test_warc_transactions(spark, tmp_path):
    same = "<p>" + "same payload " * 20 + "</p>"
    rows = [
        (3, "http://a/", same), (1, "http://b/", same), (1, "http://c/", same), (7, "http://d/\r\nX: y", same), (4, "u", "tiny"), (5, "u", "tiny"),
        (6, None, None), (None, "n", same), (8, "e", "é\r\n\r\nWARC/1.1\r\nü" * 30), (9, "s", "once"), (9, "s", "once")
    ]
    warc.write_archives(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w")
    found = warc.assemble(warc.read_archives(spark, f"{tmp_path}/w")).collect()
    assert sum(r["copies"] for r in found) == len(rows)
    assert all(r["request"] and r["metadata"] and r["response"]["digest_ok"] is not False for r in found)
    kinds = sorted((r["metadata"]["fields"].split()[1] if len(r["metadata"]["fields"].split()) > 1 else "", r["response"]["record_type"]) for r in found)
    assert [k for i, k in kinds if i == "1"] == ["response", "revisit"]
    assert [k for i, k in kinds if i in ("3", "7", "")] == ["revisit"] * 3
    odd = next(r for r in found if "page-id: 8" in r["metadata"]["fields"])
    assert bytes(odd["response"]["payload"]).decode() == rows[8][2] and odd["response"]["payload_bytes"] == len(rows[8][2].encode())


def test_archives_are_bounded_by_bytes_and_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"http://{i}/", "x" * (1 + i % 3 * 2500)) for i in range(40)]
    docs = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("clash") for c in ("payload", "digest", "uid", "first", "salt", "_copy")}).coalesce(1)
    warc.write_archives(docs, f"{tmp_path}/w")
    files = list((tmp_path / "w").glob("*.gz"))
    assert len(files) > 10 and len(gzip.decompress(files[0].read_bytes())) <= 20_000
    docs.write.parquet(f"{tmp_path}/in/pages.parquet")
    found = queries.QUERIES["op4_warc_transactions"](spark, f"{tmp_path}/in")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert found.count() == 40 and not list(shared.glob("warc-*"))


def test_warc_lone_records_and_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/e")
    records = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <r>\r\nContent-Length: 3\r\n\r\nGET\r\n\r\njunk WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <x>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [r["warc-record-id"] for r in warc.parse(records)] == ["<r>", "<m>"]
    rows = spark.createDataFrame([("<r>", "request"), ("<q>", "response")], "record_id string, record_type string")
    for c in ("concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "fields"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumns({"payload_bytes": F.lit(1).cast("long"), "digest_ok": F.lit(True), "payload": F.lit(None).cast("binary")})
    assert {r["capture_id"]: r["response"] is None for r in warc.assemble(rows).collect()} == {"<r>": True, "<q>": False}


def test_op4_contract(spark, tmp_path):
    same = "<p>" + "equal payload " * 20 + "</p>"
    rows = [
        (3, "u", same), (1, "v", same), (1, "v", same), (2, "w", "tiny"), (4, "x", "tiny"), (5, None, None), (6, "y", ""), (None, "z", same),
        (7, "u", "é" * 49), (8, "u", "é" * 49), (9, "u", "é" * 50), (10, "u", "é" * 50)
    ]
    spark.createDataFrame(rows, PAGES).withColumns(
        {c: F.lit("clash") for c in ("n", "value", "capture_id", "response")}
    ).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.QUERIES["op4_warc_transactions"](spark, str(tmp_path)).collect()
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, h in raw:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = [
        (
            i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if len(h) >= 100 and first[h] != i else "response",
            first[h] if len(h) >= 100 and first[h] != i else None
        ) for i,
        h in raw
    ]
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert queries.QUERIES["op4_warc_transactions"](spark, f"{tmp_path}/empty").count() == 0
