"""MPEG audio streams (Layers I to III) as media columns.

``parse_stream`` resynchronises on frame headers, parses ID3v1/ID3v2 tags and
Xing/VBRI tables of variable bit rate, verifies frame checksums of all three
layers, and gives exact durations and frame offsets for seeking. ``store_payload`` puts bytes into a
stream of silent frames as ancillary data, losslessly, with a checksum on each
frame, a tag and a Xing table; ``read_payload`` gets them back from its frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, map_arrow, whole_text

# Fixed values of the format: bit rates in kbit/s by version and layer, sample rates, slots.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Fixed values of the format: Layer II's bits of allocation as (subbands, bits each), by table.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}

#: Bytes of streams that a worker hands on at once, beyond the last of them.
CHUNK_BYTES = 16 << 20

FRAME_BYTES = 960  # 320 kbit/s at 48 kHz
HEAD_BYTES = 38  # header 4, checksum 2, side information 32
ROOM = FRAME_BYTES - HEAD_BYTES


def header(word: int) -> dict | None:
    """A frame header's fields, or None if the 32 bits are none."""
    version, layer, rate, sampling = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or sampling == 3:
        return None
    kbit = BITRATES[1 if version == 3 else 2, layer][rate]
    hz, padding = SAMPLE_RATES[version][sampling], word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * kbit * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + padding
    mode, extension = word >> 6 & 3, word >> 4 & 3
    mono = mode == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return {"version": version, "layer": layer, "kbit": kbit, "hz": hz, "samples": samples, "size": size, "protected": not word >> 16 & 1, "channels": 1 if mono else 2, "side": side, "joint": 4 * (extension + 1) if mode == 1 else None}


def _crc_table():
    import numpy as np

    t = np.arange(256, dtype=np.uint16) << np.uint16(8)
    for _ in range(8):
        t = np.where(t & np.uint16(0x8000), (t << np.uint16(1)) ^ np.uint16(0x8005), t << np.uint16(1)).astype(np.uint16)
    return t


_CRC: list = []


def frame_crcs(rows):
    """CRC-16 of the format (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    import numpy as np

    if not _CRC:
        _CRC.append(_crc_table())
    table = _CRC[0]
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        crc = (crc << np.uint16(8)) ^ table[(crc >> np.uint16(8)).astype(np.uint8) ^ rows[:, k]]
    return crc


def allocation_widths(h: dict) -> list[int]:
    """Bits of allocation of each of a Layer II frame's subbands."""
    each = h["kbit"] // h["channels"]
    if h["version"] != 3:
        name = "lsf"
    elif each <= 48:
        name = "d" if h["hz"] == 32000 else "c"
    else:
        name = "a" if h["hz"] == 48000 or each <= 80 else "b"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def guarded_bits(h: dict, frame: bytes) -> int:
    """Bits behind the checksum of a protected frame that it covers: side
    information (Layer III), allocation (Layer I), or allocation and the choice
    of scale factors (Layer II). Joint subbands have one allocation for both channels."""
    if h["layer"] == 3:
        return 8 * h["side"]
    widths = [4] * 32 if h["layer"] == 1 else allocation_widths(h)
    bound = len(widths) if h["joint"] is None else min(h["joint"], len(widths))
    counts = [h["channels"] if i < bound else 1 for i in range(len(widths))]
    covered = sum(n * w for n, w in zip(counts, widths))
    if h["layer"] == 1:
        return covered
    bits, left = int.from_bytes(frame[6 : 6 + (covered + 7) // 8], "big"), (covered + 7) // 8 * 8
    chosen = 0
    for i, (n, w) in enumerate(zip(counts, widths)):
        for _ in range(n):
            left -= w
            if bits >> left & ((1 << w) - 1):
                chosen += 2 * (h["channels"] if i >= bound else 1)
    return covered + chosen


def frame_crc(h: dict, frame: bytes) -> int:
    """The checksum that a protected frame of any layer should have."""
    if not _CRC:
        _CRC.append(_crc_table())
    table, crc, n = _CRC[0], 0xFFFF, guarded_bits(h, frame)
    for b in frame[2:4] + frame[6 : 6 + n // 8]:
        crc = (crc << 8 & 0xFFFF) ^ int(table[crc >> 8 ^ b])
    for k in range(n % 8):
        top = (crc >> 15) ^ (frame[6 + n // 8] >> (7 - k) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """(start of audio, end of audio, tags) after the tags at both ends."""
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data) and max(data[at + 6 : at + 10]) < 128:
        size = _syncsafe(data[at + 6 : at + 10])
        major, k, stop = data[at + 3], at + 10, min(at + 10 + size, len(data))
        if data[at + 5] & 0x40 and k + 4 <= stop:  # extended header
            k += _syncsafe(data[k : k + 4]) if major == 4 else int.from_bytes(data[k : k + 4], "big") + 4
        while major >= 3 and k + 10 <= stop and data[k : k + 4].isalnum():
            n = _syncsafe(data[k + 4 : k + 8]) if major == 4 else int.from_bytes(data[k + 4 : k + 8], "big")
            name, body = data[k : k + 4].decode("latin-1"), data[k + 10 : min(k + 10 + n, stop)]
            if name.startswith("T") and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                text = body[1:].decode(coding, "replace").rstrip("\0")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags.setdefault(key, value)
            k += 10 + n
        at = at + 10 + size + (10 if data[at + 5] & 0x10 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            if text := data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, text)
    return min(at, end), end, tags


def _vbr_table(data: bytes, at: int, h: dict) -> dict | None:
    """Xing/Info or VBRI fields of the first frame. toc: Xing has a hundred places
    in 256ths of the stream, VBRI the bytes of each run of frames_per_entry frames."""
    k = at + 4 + 2 * h["protected"] + h["side"]
    if data[k : k + 4] in (b"Xing", b"Info"):
        flags, k = int.from_bytes(data[k + 4 : k + 8], "big"), k + 8
        out: dict = {"kind": "xing"}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[k : k + 4], "big")
                k += 4
        if flags & 4:
            out["toc"] = list(data[k : k + 100])
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        number = lambda k, n: int.from_bytes(data[k : k + n], "big")
        entries, scale, width, k = number(at + 54, 2), number(at + 56, 2), number(at + 58, 2), at + 62
        toc = [number(k + i * width, width) * scale for i in range(entries) if 1 <= width <= 4 and k + (i + 1) * width <= len(data)]
        return {"kind": "vbri", "bytes": number(at + 46, 4), "frames": number(at + 50, 4), "frames_per_entry": number(at + 60, 2), "toc": toc}
    return None


def parse_stream(data: bytes) -> dict:
    """What a stream holds.

    A frame counts if it lies whole in the stream, and if another header of the
    same version, layer and sample rate, or the end, follows it; a run of frames
    is left at the first that doesn't, and the next header is searched from
    there. offsets has each audio frame's first byte (the frame of a VBR table
    is not audio); duration is in samples and seconds, exact by the frame count.
    """
    import numpy as np

    start, end, tags = _tags(data)
    view = np.frombuffer(data, np.uint8)
    sync = np.flatnonzero((view[start : max(start, end - 3)] == 0xFF) & (view[start + 1 : max(start, end - 3) + 1] >= 0xE0)) + start if end - start >= 4 else np.zeros(0, np.int64)
    offsets: list[int] = []
    sizes: list[int] = []
    heads: list[dict] = []
    at, skipped, known = start, 0, {}
    base = None
    while at + 4 <= end:
        word = int.from_bytes(data[at : at + 4], "big")
        h = known.get(word) or known.setdefault(word, header(word) or {})
        good = bool(h) and at + h["size"] <= end
        if good and at + h["size"] + 4 <= end and not (offsets and base == (h["version"], h["layer"], h["hz"])):
            after = header(int.from_bytes(data[at + h["size"] : at + h["size"] + 4], "big"))
            good = after is not None and (after["version"], after["layer"], after["hz"]) == (h["version"], h["layer"], h["hz"])
        if good:
            base = (h["version"], h["layer"], h["hz"])
            offsets.append(at)
            sizes.append(h["size"])
            heads.append(h)
            at += h["size"]
            continue
        base = None
        nxt = int(sync[i]) if (i := np.searchsorted(sync, at + 1)) < len(sync) else end
        skipped += nxt - at
        at = nxt
    skipped += max(0, end - at)
    vbr = _vbr_table(data, offsets[0], heads[0]) if offsets else None
    bad = protected = 0
    by_side: dict[int, list[int]] = {}
    for o, z, h in zip(offsets, sizes, heads):
        protected += h["protected"]
        if h["protected"] and h["layer"] == 3:
            by_side.setdefault(h["side"], []).append(o)
        elif h["protected"]:
            bad += frame_crc(h, data[o : o + z]) != int.from_bytes(data[o + 4 : o + 6], "big")
    for side, at_frames in by_side.items():
        o = np.array(at_frames)[:, None]
        rows = np.concatenate([view[o + np.array([2, 3])], view[o + 6 + np.arange(side)]], axis=1)
        stored = view[o[:, 0] + 4].astype(np.uint16) << np.uint16(8) | view[o[:, 0] + 5]
        bad += int((frame_crcs(rows) != stored).sum())
    audio = slice(1, None) if vbr else slice(None)
    samples = sum(h["samples"] for h in heads[audio])
    hz = heads[0]["hz"] if heads else 0
    return {"tags": tags, "vbr": vbr, "offsets": offsets[audio], "sizes": sizes[audio], "heads": heads[audio], "frames": len(heads[audio]), "samples": samples, "hz": hz, "seconds": samples / hz if hz else 0.0, "skipped": skipped, "protected": protected, "bad_checksums": bad, "kbits": sorted({h["kbit"] for h in heads[audio]})}


_HEAD_WORD = 0xFFFA0000 | 1 << 10  # MPEG-1, Layer III, protected, 48 kHz, stereo
#: Frame sizes at 48 kHz, a multiple of 3 bytes for each kbit/s.
_LAST = [(3 * k, i) for i, k in enumerate(BITRATES[1, 3]) if 3 * k > HEAD_BYTES]


def _frames(payload: bytes, size: int, rate: int):
    """Frames of one size with the payload in their ancillary data."""
    import numpy as np

    room = size - HEAD_BYTES
    n = -(-len(payload) // room)
    out = np.zeros((n, size), np.uint8)
    out[:, :4] = np.frombuffer(struct.pack(">I", _HEAD_WORD | rate << 12), np.uint8)
    crc = int(frame_crcs(np.concatenate([out[:1, 2:4], out[:1, 6:HEAD_BYTES]], axis=1))[0])
    out[:, 4], out[:, 5] = crc >> 8, crc & 255
    body = np.zeros(n * room, np.uint8)
    body[: len(payload)] = np.frombuffer(payload, np.uint8)
    out[:, HEAD_BYTES:] = body.reshape(n, room)
    return out.tobytes()


def store_payload(payload: bytes) -> bytes:
    """An ID3v2 tag with the payload's length, a frame with a Xing table, frames
    of 320 kbit/s, and a last frame of the lowest rate that holds the rest."""
    whole = len(payload) // ROOM * ROOM
    audio = _frames(payload[:whole], FRAME_BYTES, 14) if whole else b""
    if rest := payload[whole:]:
        size, rate = next((s, r) for s, r in _LAST if s - HEAD_BYTES >= len(rest))
        audio += _frames(rest, size, rate)
    frames = -(-len(payload) // ROOM)
    text = b"TXXX" + _frame_size(body := b"\x03payload-bytes\0" + str(len(payload)).encode()) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + _frame_size(text) + text
    total = FRAME_BYTES + len(audio)
    toc = bytes(min(255, 256 * (FRAME_BYTES + frames * k // 100 * FRAME_BYTES) // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, frames, total) + toc
    first = bytearray(_frames(b"\0", FRAME_BYTES, 14))
    first[HEAD_BYTES : HEAD_BYTES + len(table)] = table
    return tag + bytes(first) + audio


def _frame_size(body: bytes) -> bytes:
    n = len(body)
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def read_payload(data: bytes, parsed: dict | None = None) -> bytes:
    """The bytes that store_payload stored, from the frames of the stream."""
    parsed = parsed or parse_stream(data)
    parts = [data[o + HEAD_BYTES : o + s] for o, s in zip(parsed["offsets"], parsed["sizes"])]
    return b"".join(parts)[: int(parsed["tags"].get("payload-bytes", 0))]


def padded(text: str) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def feature(parsed: dict) -> str:
    """Frames, samples, rate, checksums and every seek point's offset in short."""
    o, n = parsed["offsets"], parsed["frames"]
    seek = [o[n * k // 10] for k in range(10)] if n else []
    return f"frames={n};samples={parsed['samples']};hz={parsed['hz']};kbit={','.join(map(str, parsed['kbits']))};crc={parsed['protected'] - parsed['bad_checksums']}/{parsed['protected']};skipped={parsed['skipped']};seek={','.join(map(str, seek))}"


def audio_columns(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """A table with a binary column of streams to ``keep`` and frames, samples,
    hz, seconds, bad_checksums, skipped_bytes, tags (map), frame_offsets (array).
    Null streams count as empty."""
    from pyspark.sql import types as T

    rows = df.select(*keep, F.coalesce(F.col(media_col), F.lit(b"")).alias(m := fresh("media_", keep)))
    new = "frames long, samples long, hz int, seconds double, bad_checksums long, skipped_bytes long, tags map<string,string>, frame_offsets array<long>"
    schema = T.StructType([f for f in rows.schema.fields if f.name != m] + T.StructType.fromDDL(new).fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .mpeg_audio import parse_stream

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
        for batch in batches:
            got = [parse_stream(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            values = [[p[k] for p in got] for k in ("frames", "samples", "hz", "seconds", "bad_checksums", "skipped")] + [[list(p["tags"].items()) for p in got], [p["offsets"] for p in got]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(values, kinds))], names=schema.fieldNames())

    return map_arrow(rows, run, schema)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Whole texts stored as streams and read back: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, seconds, and with ``with_media`` the stream itself (media).

    Defined results: null and empty texts are 64 bytes 0; equal texts give equal
    values; null ids pass through; an empty table gives an empty one; other
    columns are dropped. Long texts are whole: a worker holds one at a time, and of
    wanted streams CHUNK_BYTES more.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double" + (", media binary" if with_media else "")

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import zlib

        import pyarrow as pa

        from .mpeg_audio import CHUNK_BYTES, feature, padded, parse_stream, read_payload, store_payload

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.binary()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_py()
                payload = padded(raw)
                media = store_payload(payload)
                parsed = parse_stream(media)
                back = read_payload(media, parsed)
                row = (doc.as_py(), len(raw.encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed), parsed["seconds"])
                rows.append((*row, media) if with_media else row)
                held += len(media) if with_media else 0
                if len(rows) == 500 or held > CHUNK_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), run, schema)
