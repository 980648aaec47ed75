"""Ogg as a media column: write 8-bit samples as pages, read pages back, and describe what is there.

A page has a header (capture pattern, flags, granule position, stream serial,
sequence number, checksum, lacing values) and up to 255 segments. A packet is
the segments up to one shorter than 255 bytes and may go on in the stream's next
page. Pages of several logical streams are interleaved. The granule position is
the number of samples up to the end of the last packet that ends on the page, so
it gives the time in a stream; -1 says that no packet ends there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, flat, read

# Fixed values of the container format and of the two streams written here.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
AUDIO, INDEX = 1, 2
AUDIO_HEAD = struct.Struct("<8sBIQ")  # magic, channels, samples a second, unpadded length
AUDIO_MAGIC, INDEX_MAGIC = b"PCM8HEAD", b"INDXHEAD"
RATE, UNIT, PACKET = 8000, 192, 1920

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of a page, most significant bit first, from zero: zlib's over mirrored bytes, mirrored."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Stream:
    """A logical stream as read: whole packets, the granule position where each ends (None if unknown), and what was wrong."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False


def pages_of(serial: int, packets: Iterable[bytes], granules: Iterable[int], alone: int = 1) -> list[bytes]:
    """Pages of one stream. The first ``alone`` packets get pages of their own, as headers do."""
    packets, granules = list(packets), list(granules)
    pages: list[tuple[int, int, bytes, bytes]] = []  # flags, granule, lacing, body
    lacing, body, granule, going = bytearray(), bytearray(), -1, False

    def emit() -> None:
        nonlocal lacing, body, granule, going
        pages.append((CONTINUED if going else 0, granule, bytes(lacing), bytes(body)))
        going = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), bytearray(), -1

    for i, (packet, end) in enumerate(zip(packets, granules, strict=True)):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            room = 255 - len(lacing)
            if not room:
                emit()
                continue
            part, values = values[:room], values[room:]
            n = sum(part) if part[-1] < 255 else 255 * len(part)
            lacing += part
            body += packet[at : at + n]
            at += n
        granule = end
        if i < alone:
            emit()
    if lacing or not pages:
        emit()
    out = []
    for k, (flags, granule, lace, data) in enumerate(pages):
        flags |= (FIRST if k == 0 else 0) | (LAST if k == len(pages) - 1 else 0)
        head = HEADER.pack(CAPTURE, 0, flags, granule, serial, k, 0, len(lace)) + lace + data
        out.append(head[:22] + checksum(head).to_bytes(4, "little") + head[26:])
    return out


def interleave(streams: list[list[bytes]]) -> bytes:
    """First pages of all streams, then the others in turn."""
    out = [s[0] for s in streams]
    for k in range(1, max(len(s) for s in streams)):
        out.extend(s[k] for s in streams if k < len(s))
    return b"".join(out)


def read_pages(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial. A page whose checksum is wrong is left out, and packets with missing parts are lost, not guessed."""
    streams: dict[int, Stream] = {}
    held: dict[int, bytearray | None] = {}
    expect: dict[int, int] = {}
    at = 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(data):
            break
        _, version, flags, granule, serial, sequence, crc, count = HEADER.unpack_from(data, at)
        lace = data[at + HEADER.size : at + HEADER.size + count]
        end = at + HEADER.size + count + sum(lace)
        page = data[at:end]
        if version or len(lace) < count or end > len(data) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            at += 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        gap = sequence != expect.get(serial, 0)
        expect[serial] = sequence + 1
        s.pages += 1
        s.ended |= bool(flags & LAST)
        part = held.get(serial)
        if part is not None and (gap or not flags & CONTINUED):
            s.lost += 1
            part = None
        skip = part is None and bool(flags & CONTINUED)
        part = bytearray() if part is None else part
        pos, done = at + HEADER.size + count, len(s.packets)
        for value in lace:
            part += data[pos : pos + value]
            pos += value
            if value < 255:
                if skip:
                    s.lost += 1
                    skip = False
                else:
                    s.packets.append(bytes(part))
                    s.granules.append(None)
                part = bytearray()
        if len(s.packets) > done:
            s.granules[-1] = granule
        open_ = bool(lace) and lace[-1] == 255
        held[serial] = part if open_ and not skip else None
        at = end
    return streams


def encode(text: bytes) -> bytes:
    """A text as two streams: 8-bit samples in packets of 1920, and an index with the first sample of each packet.

    Spaces pad the samples to a positive multiple of 192; the header keeps the unpadded length.
    """
    payload = text + b" " * (-len(text) % UNIT or (0 if text else UNIT))
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    audio = [AUDIO_HEAD.pack(AUDIO_MAGIC, 1, RATE, len(text)), *cut]
    ends = np.cumsum([len(c) for c in cut]).tolist()
    index = [INDEX_MAGIC, struct.pack(f"<{len(cut)}Q", *(e - len(c) for e, c in zip(ends, cut, strict=True)))]
    return interleave([pages_of(AUDIO, audio, [0, *ends]), pages_of(INDEX, index, [0, ends[-1]])])


def decode(media: bytes) -> tuple[bytes, int, str]:
    """(samples, unpadded length, feature) of what ``encode`` wrote.

    The feature gives streams, pages, packets, lost packets, the rate, the
    duration from the last granule position in milliseconds, the time at which
    the last page with an earlier granule position ends, and whether the index
    agrees with the packets.
    """
    streams = read_pages(media)
    audio, index = streams[AUDIO], streams[INDEX]
    magic, channels, rate, length = AUDIO_HEAD.unpack(audio.packets[0])
    if magic != AUDIO_MAGIC or index.packets[0] != INDEX_MAGIC:
        raise ValueError("not these streams")
    body = audio.packets[1:]
    first = np.frombuffer(index.packets[1], "<u8")
    own = np.cumsum([0, *(len(p) for p in body)])
    known = [g for g in audio.granules[1:] if g is not None]
    ms = lambda g: g * 1000 // (rate * channels)
    fields = {
        "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(body), "lost": sum(s.lost for s in streams.values()),
        "rate": rate, "ms": ms(known[-1]), "page_ms": ms(known[-2]) if len(known) > 1 else 0, "index": int(np.array_equal(first, own[:-1]) and known[-1] == own[-1]), "ended": int(audio.ended and index.ended),
    }
    return b"".join(body), length, ";".join(f"{k}={v}" for k, v in fields.items())


def to_ogg(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``media``: each whole text as Ogg bytes; a null text is empty.

    Equal texts have equal bytes. A column that is named ``media`` already is
    returned with ``_in`` after its name. An empty table stays empty.
    """
    return _with(rows, text, "media", "binary", lambda raw: (encode(raw),))


def from_ogg(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with payload (binary), n_bytes (unpadded) and feature, read back from Ogg bytes.

    Media whose headers or index are gone have a null payload and the feature
    "damaged", as null media have. Columns that have these names already are
    returned with ``_in`` after them.
    """

    def work(raw: bytes) -> tuple[bytes | None, int | None, str]:
        try:
            return decode(raw)
        except (KeyError, IndexError, ValueError, struct.error):
            return None, None, "damaged"

    return _with(rows, media, ["payload", "n_bytes", "feature"], ["binary", "long", "string"], work)


def _with(rows: DataFrame, column: str, names, kinds, work) -> DataFrame:
    names, kinds = ([names], [kinds]) if isinstance(names, str) else (names, kinds)
    was = rows.columns.index(column)
    rows = aside(rows, *names)
    keep = rows.columns
    schema = rows.select(*[f"`{c}`" for c in keep]).schema
    for n, k in zip(names, kinds, strict=True):
        schema = schema.add(n, k)
    types = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(was))
            for lo in range(0, batch.num_rows, 256):
                hi = min(lo + 256, batch.num_rows)
                out = [work(buf[offsets[i] : offsets[i + 1]].tobytes()) for i in range(lo, hi)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[j] for x in out], types[k]) for j, k in enumerate(kinds))], [*keep, *names])

    return rows.mapInArrow(run, schema)


def op6_ogg_media(spark, sf_dir: str) -> DataFrame:
    made = to_ogg(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    back = from_ogg(made)
    payload = F.col("payload")
    tail = F.substring(payload, F.lit(-16), F.lit(16))
    return back.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
