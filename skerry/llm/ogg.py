"""Media columns: Ogg. Binary columns hold physical bitstreams; pages are checked and demultiplexed.

Writing: a payload is cut into 192-byte frames of 8-bit samples. Even frames go to one logical stream, odd
frames to another; four frames make a packet. Packets longer than 254 bytes take several lacing values and may
continue on the next page.
Reading: pages are found by their capture pattern, their checksums verified, streams told apart by serial number,
packets put together from lacing values, and times taken from granule positions.

Null and empty texts become one frame of spaces. A damaged page is counted and skipped with what continues it;
bytes that are no page are skipped. Equal payloads give equal bitstreams.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FRAME = 192
FRAMES_A_PACKET = 4
SEGMENTS_A_PAGE = 62
SAMPLE_RATE = 8000
MAGIC = b"OggS"
HEADER = "<4sBBqIIIB"
HEADER_SIZE = struct.calcsize(HEADER)
CONTINUED, FIRST, LAST = 1, 2, 4
IDENT = b"\x01pcm8\x00"

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """The container's checksum (polynomial 0x04C11DB7, most significant bit first, no inversion).

    It is the bit-mirrored form of the common CRC-32, so zlib computes it over mirrored bytes.
    """
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: list[int], body: bytes) -> bytes:
    head = struct.pack(HEADER, MAGIC, 0, kind, granule, serial, number, 0, len(lacing)) + bytes(lacing)
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _stream_pages(serial: int, ident: bytes, packets: list[bytes]) -> list[bytes]:
    """One logical stream: an identification packet on its own page, then the data packets."""
    pages = [_page(FIRST if packets else FIRST | LAST, 0, serial, 0, [len(ident)], ident)]
    lacing: list[int] = []
    body: list[bytes] = []
    samples, granule, continued = 0, -1, False

    def flush(last: bool, unfinished: bool) -> None:
        nonlocal lacing, body, granule, continued
        kind = (CONTINUED if continued else 0) | (LAST if last else 0)
        pages.append(_page(kind, granule, serial, len(pages), lacing, b"".join(body)))
        lacing, body, granule, continued = [], [], -1, unfinished

    for k, packet in enumerate(packets):
        at, size = 0, len(packet)
        while True:
            if len(lacing) == SEGMENTS_A_PAGE:
                flush(False, at > 0)
            take = min(255, size - at)
            lacing.append(take)
            body.append(packet[at : at + take])
            at += take
            if take < 255:
                break
        samples += size
        granule = samples
        if k == len(packets) - 1:
            flush(True, False)
    return pages


def encode(payload: bytes) -> bytes:
    """The bitstream of a payload whose length is a positive multiple of FRAME."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    serial = zlib.crc32(payload)
    streams = []
    for k in (0, 1):
        own = frames[k::2]
        packets = [b"".join(own[i : i + FRAMES_A_PACKET]) for i in range(0, len(own), FRAMES_A_PACKET)]
        streams.append(_stream_pages((serial + k) & 0xFFFFFFFF, IDENT + struct.pack("<BIH", k, SAMPLE_RATE, FRAME), packets))
    a, b = streams
    out = [a[0], b[0]]
    for i in range(1, max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


def pages(data: bytes) -> Iterator[dict]:
    """The pages of a bitstream, in order; ok tells whether the checksum holds."""
    at = 0
    while (at := data.find(MAGIC, at)) >= 0:
        if at + HEADER_SIZE > len(data):
            return
        _, version, kind, granule, serial, number, crc, count = struct.unpack_from(HEADER, data, at)
        lacing = data[at + HEADER_SIZE : at + HEADER_SIZE + count]
        end = at + HEADER_SIZE + count + sum(lacing)
        ok = version == 0 and len(lacing) == count and end <= len(data)
        if ok:
            whole = data[at:end]
            ok = page_crc(whole[:22] + b"\0\0\0\0" + whole[26:]) == crc
        yield {
            "ok": ok, "kind": kind, "granule": granule, "serial": serial, "number": number, "lacing": lacing,
            "body": data[at + HEADER_SIZE + count : end] if ok else b""
        }
        at = end if ok else at + 4


def demultiplex(data: bytes) -> tuple[dict[int, dict], int, int]:
    """Streams by serial number (packets, times of their ends in samples or -1, gaps), sound pages, damaged pages."""
    streams: dict[int, dict] = {}
    good = bad = 0
    for p in pages(data):
        if not p["ok"]:
            bad += 1
            continue
        good += 1
        s = streams.setdefault(p["serial"], {"packets": [], "ends": [], "next": p["number"], "part": None, "gaps": 0, "ended": False})
        if p["number"] != s["next"]:
            s["gaps"] += 1
            s["part"] = None
        s["next"] = p["number"] + 1
        s["ended"] |= bool(p["kind"] & LAST)
        part, lost, at = (s["part"] if p["kind"] & CONTINUED else []), False, 0
        if p["kind"] & CONTINUED and s["part"] is None:
            part, lost = [], True
        elif part is None:
            part = []
        finished = 0
        for size in p["lacing"]:
            part.append(p["body"][at : at + size])
            at += size
            if size < 255:
                if not lost:
                    s["packets"].append(b"".join(part))
                    s["ends"].append(-1)
                    finished += 1
                part, lost = [], False
        if finished:
            s["ends"][-1] = p["granule"]
        s["part"] = None if lost else (part or None)
    return streams, good, bad


def packet_times(stream: dict) -> list[tuple[int, int]]:
    """Start and end, in samples, of each packet of a stream after its first, which identifies it.

    A granule position is the end of the last packet that a page completes. The packets before it on the page end where
    the next one starts, and a packet of 8-bit samples lasts as many samples as it has bytes. So times hold after a gap too.
    """
    sizes = [len(p) for p in stream["packets"][1:]]
    ends, out = stream["ends"][1:], []
    following = None
    for size, end in zip(reversed(sizes), reversed(ends), strict=True):
        end = following if end < 0 else end
        out.append((size, end))
        following = None if end is None else end - size
    out.reverse()
    at, times = 0, []
    for size, end in out:  # without a granule behind it a packet follows the one before
        times.append((at, at + size) if end is None else (end - size, end))
        at = times[-1][1]
    return times


def decode(data: bytes) -> dict:
    """The payload and what was found about the container."""
    streams, good, bad = demultiplex(data)
    lanes: dict[int, bytes] = {}
    rate, span, starts = SAMPLE_RATE, 0, []
    for s in streams.values():
        if s["packets"] and s["packets"][0].startswith(IDENT):
            lane, rate, _ = struct.unpack_from("<BIH", s["packets"][0], len(IDENT))
            lanes[lane] = b"".join(s["packets"][1:])
            times = packet_times(s)
            span = max([span, *(end for _, end in times)])
            starts += [begin / rate for begin, _ in times]
    a, b = lanes.get(0, b""), lanes.get(1, b"")
    out = bytearray(len(a) + len(b))
    for k, lane in ((0, a), (1, b)):
        for i in range(0, len(lane), FRAME):
            to = (2 * (i // FRAME) + k) * FRAME
            out[to : to + FRAME] = lane[i : i + FRAME]
    return {
        "payload": bytes(out), "streams": len(streams), "pages": good, "damaged": bad,
        "packets": sum(len(s["packets"]) for s in streams.values()), "gaps": sum(s["gaps"] for s in streams.values()), "seconds": span / rate,
        "starts": starts,
    }


FOUND = {
    "payload": pa.binary(), "streams": pa.int32(), "pages": pa.int64(), "packets": pa.int64(), "damaged": pa.int64(), "gaps": pa.int64(),
    "seconds": pa.float64(), "starts": pa.list_(pa.float64())
}
"""What read_media adds, in this order."""
_DDL = ("binary", "int", "long", "long", "long", "long", "double", "array<double>")


def _encoded(out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            for at, n in common.row_groups(last):
                texts = common.raw_bytes(last.slice(at, n))
                media = [encode(t + b" " * (-len(t) % FRAME or (0 if t else FRAME))) for t in texts]
                kept = [c.slice(at, n) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[*batch.schema.names[:-1], *out]
                )

    return run


def _decoded(out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            for at, n in common.row_groups(last):
                found = [decode(m) for m in common.raw_bytes(last.slice(at, n))]
                kept = [c.slice(at, n) for c in batch.columns]
                made = [pa.array([x[k] for x in found], t) for k, t in FOUND.items()]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names, *out])

    return run


def write_media(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_bytes and the binary column media, one bitstream a row; names that clash with one of keep end in underscores.
    What is encoded at a time holds some megabytes of text, or one row."""
    kept = df.select(*(F.col(f"`{c}`") for c in keep))
    size, media, own = common.free_names(kept, "n_bytes", "media", "_text")
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(own))
    return common.map_batches(rows, _encoded([size, media]), ", ".join(x for x in (common.ddl(kept), f"`{size}` long, `{media}` binary") if x))


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns of df, the payload, and what was found about the container: among it starts, the time in seconds at which
    each packet begins, one stream after the other. Names that clash with a column of df end in underscores."""
    names = common.free_names(df, *FOUND)
    rows = common.with_last(df, media)
    more = ", ".join(f"`{n}` {t}" for n, t in zip(names, _DDL, strict=True))
    return common.as_before(common.map_batches(rows, _decoded(names), f"{common.ddl(rows)}, {more}"), df, *names)


def op1(spark, sf_dir: str) -> DataFrame:
    found = read_media(write_media(common.table(spark, sf_dir, "documents"), ["doc_id"]))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string(
            "streams=%d pages=%d packets=%d damaged=%d gaps=%d seconds=%.3f", "streams", "pages", "packets", "damaged", "gaps", "seconds"
        ).alias("feature"),
        F.size("starts").cast("long").alias("timed_packets"), F.array_max("starts").alias("last_packet_start"),
    )
