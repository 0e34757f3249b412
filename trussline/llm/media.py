"""Media columns: ISO base media containers, written from bytes and read by walking nested boxes.

The reader never decodes payloads: it walks the boxes (32- and 64-bit sizes,
and boxes to the end of the file), decodes each track's sample tables (stsd,
mdhd, stts, stsc, stsz, stco or co64, stss) and the runs of fragments (trex,
tfhd, trun), and gives codec, duration and the byte ranges of samples and key
frames. The writer stores a payload losslessly as 8-bit
mono PCM samples, FRAME of them to a table entry, in a single track.

Edge cases: a null text is empty, and its payload is one unit of padding;
equal texts give equal values; repeated rows give a row each; empty input gives
no rows; null ids stay null; other columns are ignored. A file with a box that
runs past its parent, counts that its tables or bytes do not bear out, or no
track with samples raises ValueError in ``read_tracks`` and gives a null in
``media_columns``; samples cost memory by the file's own size at most.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Payload bytes are padded to a multiple of UNIT; samples to a table entry; entries from one key frame to the next; entries to a chunk; samples a second.
UNIT, FRAME, GAP, CHUNK, RATE = 192, 192, 8, 16, 8000
#: Boxes that hold boxes (fixed values of the format).
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data with spaces up to a positive multiple of unit."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def write_media(payload: bytes) -> bytes:
    """A file with one track that holds payload; its length is a multiple of FRAME."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(at: int) -> bytes:
        entry = box(b"raw ", struct.pack(">6xHHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
        last = n - (chunks - 1) * CHUNK
        runs = [(1, CHUNK, 1)] * (chunks > 1 or last == CHUNK) + [(chunks, last, 1)] * (last != CHUNK)
        offsets = at + np.arange(chunks, dtype=np.uint64) * (CHUNK * FRAME)
        wide = at + len(payload) >= 1 << 32
        keys = np.arange(1, n + 1, GAP, dtype=">u4")
        table = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, FRAME)), full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", FRAME, n)), full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()), full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        )
        length = n * FRAME
        media = box(
            b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, min(length, 0xFFFFFFFF), 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"payload\0"),
            box(b"minf", full(b"smhd", struct.pack(">I", 0)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, min(length, 0xFFFFFFFF), 0, 0, 0x100, 0), _UNITY, struct.pack(">II", 0, 0), flags=7)
        movie = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, min(length, 0xFFFFFFFF), 0x10000, 0x100), _UNITY, struct.pack(">24xI", 2))
        return box(b"moov", movie, box(b"trak", track, media))

    size = len(moov(0))
    body = box(b"mdat", payload)
    start = len(head) + size + len(body) - len(payload)
    return head + moov(start) + body


def walk(data: bytes, start: int = 0, end: int | None = None, at: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box kinds, first and end byte of its body) of every box, parents first."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if not body <= stop <= end:
            raise ValueError(f"box {kind!r} runs past its parent")
        yield (*at, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*at, kind))
        start = stop


def _numbers(data: bytes, at: int, end: int, count: int, kind: str = ">u4") -> np.ndarray:
    """count numbers from at on, all of them before end."""
    if count < 0 or at + count * np.dtype(kind).itemsize > end:
        raise ValueError("a table is shorter than its count")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _table(data: bytes, box_: tuple[int, int], columns: int) -> np.ndarray:
    """The rows of a table that has a count before them."""
    n = int(_numbers(data, box_[0], box_[1], 1)[0])
    return _numbers(data, box_[0] + 4, box_[1], n * columns).reshape(n, columns)


def _sample_table(data: bytes, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(first byte, size, whether a key frame) of a track's samples in its sample tables, and their length in time."""
    same, count = map(int, _numbers(data, *t[b"stsz"], 2))
    if same and count * same > len(data):
        raise ValueError("more samples than the file has bytes")
    sizes = np.full(count, same, np.int64) if same else _numbers(data, t[b"stsz"][0] + 8, t[b"stsz"][1], count)
    if sizes.sum() > len(data):
        raise ValueError("samples larger than the file")
    wide = b"stco" not in t
    at = t[b"co64" if wide else b"stco"]
    offsets = _numbers(data, at[0] + 4, at[1], int(_numbers(data, *at, 1)[0]), ">u8" if wide else ">u4")
    runs = _table(data, t[b"stsc"], 3)
    first = np.append(runs[:, 0], len(offsets) + 1)
    if (np.diff(first) < 0).any() or (len(runs) and runs[0, 0] != 1):
        raise ValueError("chunk runs out of order")
    upto = np.cumsum(np.repeat(runs[:, 1], np.diff(first)))
    if count > (int(upto[-1]) if len(upto) else 0):
        raise ValueError("more samples than the chunks hold")
    chunk = np.searchsorted(upto, np.arange(count), "right")
    before = np.cumsum(sizes) - sizes
    start = offsets[chunk] + before - before[(np.append(0, upto)[chunk])] if count else before
    keys = np.ones(count, bool)
    if b"stss" in t:
        own = _table(data, t[b"stss"], 1).ravel() - 1
        if len(own) and not (0 <= own.min() and own.max() < count):
            raise ValueError("a key frame beyond the samples")
        keys[:] = False
        keys[own] = True
    times = _table(data, t[b"stts"], 2) if b"stts" in t else np.zeros((0, 2), np.int64)
    return start, sizes, keys, int((times[:, 0] * times[:, 1]).sum())


def _fragment(data: bytes, moof: int, boxes: list[tuple[bytes, int, int]], defaults: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(track, first byte, size, whether a key frame, length in time) of the runs of one fragment that begins at moof."""
    track, base, end = 0, moof, moof
    length = size = flags = 0
    for kind, a, b in boxes:
        if kind == b"tfhd":
            own = int(_numbers(data, a - 4, b, 1)[0]) & 0xFFFFFF
            track, at = int(_numbers(data, a, b, 1)[0]), a + 4
            length, size, flags = defaults.get(track, (0, 0, 0))
            base = moof
            if own & 1:
                base, at = int(_numbers(data, at, b, 1, ">u8")[0]), at + 8
            at += 4 * bool(own & 2)
            got = [int(_numbers(data, at + 4 * i, b, 1)[0]) for i in range(sum(bool(own & f) for f in (8, 16, 32)))]
            length = got.pop(0) if own & 8 else length
            size = got.pop(0) if own & 16 else size
            flags = got.pop(0) if own & 32 else flags
            end = base
        elif kind == b"trun":
            own = int(_numbers(data, a - 4, b, 1)[0]) & 0xFFFFFF
            n, at = int(_numbers(data, a, b, 1)[0]), a + 4
            if own & 1:
                end, at = base + int(_numbers(data, at, b, 1, ">i4")[0]), at + 4
            head = None
            if own & 4:
                head, at = int(_numbers(data, at, b, 1)[0]), at + 4
            names = [f for f in (0x100, 0x200, 0x400, 0x800) if own & f]
            if not names and n * max(size, 1) > len(data):
                raise ValueError("more samples than the file has bytes")
            rows = _numbers(data, at, b, n * len(names)).reshape(n, len(names))
            column = lambda f, other: rows[:, names.index(f)] if f in names else np.full(n, other, np.int64)
            sizes, flag = column(0x200, size), column(0x400, flags)
            if head is not None and n and 0x400 not in names:
                flag[0] = head
            start = end + np.cumsum(sizes) - sizes
            end += int(sizes.sum())
            if end > len(data):
                raise ValueError("samples beyond the file")
            yield track, start, sizes, (flag & 0x10000) == 0, int(column(0x100, length).sum())


def read_tracks(data: bytes) -> list[dict]:
    """Kind (handler), codec, timescale, duration in seconds, and the byte ranges of samples and key frames of every track with samples, fragments included."""
    tracks: list[dict] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[int, list]] = []
    for where, a, b in walk(data):
        kind = where[-1]
        if kind == b"trak":
            tracks.append({})
        elif kind == b"trex":
            track, _, *rest = map(int, _numbers(data, a + 4, b, 5))
            defaults[track] = tuple(rest)
        elif kind == b"moof":
            fragments.append((a - 8, []))
        elif where[0] == b"moof" and kind in (b"tfhd", b"trun"):
            fragments[-1][1].append((kind, a + 4, b))
        elif tracks and where[0] == b"moov" and b"trak" in where:
            tracks[-1][kind] = (a + 4, b)
    runs: dict[int, list] = {}
    for at, boxes in fragments:
        for track, *run in _fragment(data, at, boxes, defaults):
            runs.setdefault(track, []).append(run)
    out = []
    for t in tracks:
        if b"stsd" not in t or b"mdhd" not in t:
            continue
        parts = [_sample_table(data, t)] if b"stsz" in t and b"stsc" in t and t.keys() & {b"stco", b"co64"} else []
        if b"tkhd" in t:
            long = data[t[b"tkhd"][0] - 4] == 1
            parts += runs.get(int(_numbers(data, t[b"tkhd"][0] + (16 if long else 8), t[b"tkhd"][1], 1)[0]), [])
        if not sum(len(p[0]) for p in parts):
            continue
        start, size, keys = (np.concatenate([p[i] for p in parts]) for i in range(3))
        long = data[t[b"mdhd"][0] - 4] == 1
        scale = int(_numbers(data, t[b"mdhd"][0] + (16 if long else 8), t[b"mdhd"][1], 1)[0])
        codec = data[t[b"stsd"][0] + 8 : t[b"stsd"][0] + 12].decode("latin-1")
        handler = data[t[b"hdlr"][0] + 4 : t[b"hdlr"][0] + 8].decode("latin-1") if b"hdlr" in t else ""
        out.append({"kind": handler, "codec": codec, "timescale": scale, "duration": sum(p[3] for p in parts) / max(scale, 1), "start": start, "size": size, "keys": np.flatnonzero(keys)})
    if not out:
        raise ValueError("no track with samples")
    return out


def read_media(data: bytes) -> dict:
    """The first video track with samples, or else the first track."""
    tracks = read_tracks(data)
    return next((t for t in tracks if t["kind"] == "vide"), tracks[0])


def payload_of(data: bytes, media: dict) -> bytes:
    """The stored samples' bytes, read back by their ranges; ranges that touch are read at once."""
    start, size = media["start"], media["size"]
    if not len(start):
        return b""
    cut = np.flatnonzero(start[1:] != start[:-1] + size[:-1]) + 1
    ends = np.append(cut, len(start)) - 1
    return b"".join(data[start[i] : start[j] + size[j]] for i, j in zip(np.append(0, cut).tolist(), ends.tolist(), strict=True))


MEDIA = "array<struct<kind: string, codec: string, timescale: bigint, duration: double, samples: bigint, keyframes: array<struct<start: bigint, size: bigint>>>>"


def media_columns(files: DataFrame, column: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep columns and what the containers in a binary column say of each of their tracks, payloads untouched."""
    named = {f"k{i}": c for i, c in enumerate(keep)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))]))
        for b in batches:
            out = []
            for x in b.column(b.num_columns - 1):
                try:
                    found = read_tracks(x.as_py() or b"")
                    out.append([{k: m[k] for k in ("kind", "codec", "timescale", "duration")} | {"samples": len(m["size"]), "keyframes": [{"start": s, "size": z} for s, z in zip(m["start"][m["keys"]].tolist(), m["size"][m["keys"]].tolist(), strict=True)]} for m in found])
                except (ValueError, KeyError, struct.error, IndexError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, kind)], [*b.schema.names[:-1], "media"])

    picked = files.select(*[F.col(c).alias(k) for k, c in named.items()], F.col(column).alias("content"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return mapped(picked, read, ", ".join([*kinds, f"media {MEDIA}"])).select(*[F.col(k).alias(c) for k, c in named.items()], "media")


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as a container, read back: sizes, digests and a feature text (codec, duration, key frames and their ranges' digest, mean and spread of the samples)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    media = write_media(padded(raw))
                    m = read_media(media)
                    back = payload_of(media, m)
                    at, size = m["start"][m["keys"]], m["size"][m["keys"]]
                    samples = np.frombuffer(back, np.uint8)
                    feature = {"codec": m["codec"].strip(), "duration": round(m["duration"], 6), "samples": len(m["size"]), "keyframes": len(at), "first": [int(at[0]), int(at[0] + size[0])], "last": [int(at[-1]), int(at[-1] + size[-1])], "ranges_crc32": zlib.crc32(np.stack([at, at + size], 1).astype("<i8").tobytes()), "mean": round(float(samples.mean()), 6), "std": round(float(samples.std()), 6)}
                    rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(feature)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
