"""Ogg media columns: write, check, reassemble, demultiplex and time logical streams.

A stream here holds 8-bit samples: an identification packet, then packets of
samples. The granule position of a page is the number of samples of its stream
up to the end of the last packet that ends on the page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

HEAD, HEAD_SIZE = "<4sBBqIIIB", 27
IDENT, IDENT_SIZE = "<8sIHH", 16
IDENT_MARK = b"\x7fPCM8\x01\x00\x00"
CONTINUED, BEGIN, END = 1, 2, 4
RATE = 8000
PACKET = 576
STREAMS = 2
NO_GRANULE = -1
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, not reflected, from 0) by way of the reflected one over reversed bits."""
    raw = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return struct.pack(HEAD, b"OggS", 0, flags, granule, serial, number, crc, len(lacing)) + lacing + body


def stream_pages(serial: int, packets: list[bytes], granules: list[int], lacing_limit: int = 255) -> list[bytes]:
    """Pages of one logical stream. The first packet has a page of its own; packets go over page ends where they must."""
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), [], NO_GRANULE, False

    def flush(flags: int = 0) -> None:
        nonlocal lacing, body, granule
        begin = BEGIN if not pages else 0
        pages.append(_page(serial, len(pages), flags | begin | (CONTINUED if continued else 0), granule, bytes(lacing), b"".join(body)))
        lacing, body, granule = bytearray(), [], NO_GRANULE

    for k, (packet, at) in enumerate(zip(packets, granules)):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while values:
            room = lacing_limit - len(lacing)
            if not room:
                flush()
                continued = done > 0
                room = lacing_limit
            part, values = values[:room], values[room:]
            lacing += part
            body.append(packet[done : done + sum(part)])
            done += sum(part)
        granule = at
        if k == 0 or k == len(packets) - 1:
            flush(END if k == len(packets) - 1 else 0)
            continued = False
    return pages


def mux(payload: bytes, streams: int = STREAMS, packet: int = PACKET, rate: int = RATE) -> bytes:
    """An Ogg file of the payload's samples: packet k goes to logical stream k mod `streams`; pages alternate."""
    seed = zlib.crc32(payload)
    cut = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    tracks = []
    for s in range(streams):
        packets = [struct.pack(IDENT, IDENT_MARK, rate, s, streams), *cut[s::streams]]
        granules = np.cumsum([0, *map(len, packets[1:])]).tolist()
        tracks.append(stream_pages((seed + s) & 0xFFFFFFFF, packets, granules))
    order = [t[0] for t in tracks]
    for k in range(1, max(map(len, tracks))):
        order += [t[k] for t in tracks if k < len(t)]
    return b"".join(order)


@dataclass
class Logical:
    """One logical stream: its whole packets, and the granule at each one's end (None where it can't be derived)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    ended: bool = False
    lost: int = 0
    next_page: int = 0
    part: list[bytes] | None = None


def demux(data: bytes) -> tuple[list[Logical], int, int]:
    """Logical streams in order of appearance, pages with a right checksum, and faulty pages.

    A page with a wrong checksum, or cut off, is left out; reading goes on at the next capture pattern. Packets that
    a missing page interrupts are dropped and counted as lost.
    """
    streams: dict[int, Logical] = {}
    good = bad = at = 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + HEAD_SIZE > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEAD, data, at)
        lacing = data[at + HEAD_SIZE : at + HEAD_SIZE + n]
        start = at + HEAD_SIZE + n
        end = start + sum(lacing)
        if version or len(lacing) < n or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad += 1
            at += 4
            continue
        good += 1
        at = end
        s = streams.setdefault(serial, Logical(serial))
        if number != s.next_page or bool(flags & CONTINUED) != (s.part is not None):
            s.lost += s.part is not None or number != s.next_page
            s.part = None
        skip = bool(flags & CONTINUED) and s.part is None
        s.next_page = number + 1
        s.ended |= bool(flags & END)
        first, pos = len(s.packets), start
        piece = pos
        for v in lacing:
            pos += v
            if v < 255:
                if skip:
                    skip = False
                else:
                    s.packets.append(b"".join([*(s.part or ()), data[piece:pos]]))
                s.part, piece = None, pos
        if lacing and lacing[-1] == 255 and not skip:
            s.part = [*(s.part or ()), data[piece:pos]]
        # The granule is that of the last packet that ends here; those before end earlier by the samples between.
        known: list[int | None] = []
        for p in reversed(s.packets[first:]):
            known.append(granule if granule != NO_GRANULE else None)
            granule -= len(p) if granule != NO_GRANULE else 0
        s.granules += reversed(known)
    for s in streams.values():
        s.lost += s.part is not None
    return list(streams.values()), good, bad


def ident(stream: Logical) -> tuple[int, int, int] | None:
    """Rate, number and count of the streams, of a stream that this module can read; else None."""
    if not stream.packets or len(stream.packets[0]) != IDENT_SIZE or not stream.packets[0].startswith(IDENT_MARK):
        return None
    return struct.unpack(IDENT, stream.packets[0])[1:]


def samples(streams: list[Logical]) -> bytes:
    """The samples of all streams, interleaved as they were."""
    known = sorted((i[1], s.packets[1:]) for s in streams if (i := ident(s)))
    out = []
    for k in range(max((len(p) for _, p in known), default=0)):
        out += [p[k] for _, p in known if k < len(p)]
    return b"".join(out)


def timestamps(stream: Logical) -> list[tuple[float | None, float | None]]:
    """Start and end in seconds of each packet after the first."""
    found = ident(stream)
    rate = found[0] if found else 0
    return [
        (None, None) if g is None or not rate else ((g - len(p)) / rate, g / rate)
        for p, g in zip(stream.packets[1:], stream.granules[1:])
    ]


def pad(text: str | None, unit: int = PACKET) -> bytes:
    """UTF-8 of the text and bytes 255 up to a positive multiple of `unit`."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def encode_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: each text's padded bytes as an Ogg file. Null text: empty, so one packet of padding.
    Equal texts, equal files; repeated rows and null keys are kept; other columns are dropped."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__text"):
            rows = block.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([len((t or "").encode()) for t in rows], pa.int64()), pa.array([mux(pad(t)) for t in rows], pa.binary())],
                names=[key, "n_bytes", "media"],
            )

    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"{key} {kind}, n_bytes long, media binary")


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns of df but media, and what the file holds: payload, media_bytes, media_sha256, pages, bad_pages,
    streams, packets, lost, seconds. Null or unreadable media: an empty payload and zeros."""
    keep = [c for c in df.columns if c != media]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    more = "payload binary, media_bytes long, media_sha256 string, pages int, bad_pages int, streams int, packets int, lost int, seconds double"
    types = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def one(data: bytes) -> tuple:
        streams, good, bad = demux(data)
        last = [t[1] for s in streams for t in timestamps(s)[-1:] if t[1] is not None]
        n = sum(len(s.packets) for s in streams)
        return samples(streams), len(data), hashlib.sha256(data).hexdigest(), good, bad, len(streams), n, sum(s.lost for s in streams), max(last, default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__media"):
            rows = [one(b or b"") for b in block.column(len(keep)).to_pylist()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*block.columns[: len(keep)], *made], names=[*keep, *(f.split()[0] for f in more.split(", "))])

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{media}`").alias("__media")).mapInArrow(run, f"{fields}, {more}")


def packet_rows(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row for each packet after the identification: key, serial, packet, start_s, end_s, data."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "serial", "packet", "start_s", "end_s", "data"]
        for block in common.blocks(batches, "__media"):
            for k, data in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                rows = [(k, s.serial, i, a, b, p) for s in demux(data or b"")[0] for i, ((a, b), p) in enumerate(zip(timestamps(s), s.packets[1:]))]
                types = [block.schema.field(0).type, pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    return df.select(F.col(key), F.col(media).alias("__media")).mapInArrow(
        run, f"{key} {kind}, serial long, packet int, start_s double, end_s double, data binary"
    )


def features(df: DataFrame) -> DataFrame:
    """Replaces payload by its digests and a feature string of the samples and the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "payload"):
            out = []
            for r in block.to_pylist():
                x = np.frombuffer(r["payload"], np.uint8)
                n = max(1, len(x))
                mean = int(x.sum(dtype=np.int64)) / n
                power = float(np.square(x.astype(np.float32) - np.float32(mean)).mean(dtype=np.float64)) ** 0.5 if len(x) else 0.0
                crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                out.append(
                    {
                        "doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "payload_bytes": len(x),
                        "payload_sha256": hashlib.sha256(r["payload"]).hexdigest(), "tail_crc32": zlib.crc32(r["payload"][-32:]),
                        "media_bytes": r["media_bytes"], "media_sha256": r["media_sha256"],
                        "feature": f"pages={r['pages']};bad={r['bad_pages']};streams={r['streams']};packets={r['packets']};lost={r['lost']};seconds={r['seconds']:.4f};mean={mean:.3f};deviation={power:.3f};crossings={crossings}",
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    return df.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return features(decode(encode_texts(docs)))
