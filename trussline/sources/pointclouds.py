"""Point-cloud files as Spark data sources: ``spark.read.format("las")`` and ``format("e57")``.

A path is a file, a folder or a pattern in a folder, on any file system that
Arrow knows by its address. LAS files are split into record ranges and E57 scans
into ranges of records too (found by an index of their packets), one task each;
a task reads only its bytes and yields Arrow batches. Options: path, max_points
(0: all; then a stride over the global index, which goes on from file to file in
order of names), origin ("x,y,z"), swizzle (default true: x, z, -y). Rows: idx,
x, y, z (float) and r, g, b. Filters on idx leave out record ranges, filters on
x, y and z leave out LAS files whose header's box they miss. With the option
info rows are (file, part, points, x0 ... z1) from headers alone, one for each
file or scan, read in the tasks: counts that decode nothing.

``read_e57`` reads scans in two stages, for files too large to walk through once
a task: a first job follows the packets of each scan, the second one decodes
ranges of records from where the first has found them.

``write.format("las")`` writes points (x, y, z double, and r, g, b if they are
there) as LAS files of format 2, one for each Arrow batch; option scale;
``write.format("e57")`` writes them as E57 files of one scan, with colours from 0 to 255. append
adds files, overwrite replaces all files of that kind in the folder.
"""

from __future__ import annotations

import fnmatch
import json
import math
import struct
import uuid
import xml.etree.ElementTree as ET
from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "idx bigint, x float, y float, z float, r smallint, g smallint, b smallint"
INFO = "file string, part int, points bigint, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
#: First byte of the colours in a record, by point format (fixed values).
RGB_OFFSET = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
#: Records in a partition and in a batch; the grey of points without colour.
PART, BATCH, GREY = 4_000_000, 1 << 18, 180


def step_for(total: int, most: int) -> int:
    """Every how many points one is kept."""
    return math.ceil(total / most) if most and total > most else 1


def placed(x: np.ndarray, y: np.ndarray, z: np.ndarray, origin: tuple[float, float, float], swizzle: bool) -> tuple[np.ndarray, ...]:
    """World coordinates: rebased in doubles, turned, and only then cut to floats."""
    e, n, h = x - origin[0], y - origin[1], z - origin[2]
    return tuple(c.astype(np.float32) for c in ((e, h, -n) if swizzle else (e, n, h)))


def batch(idx: np.ndarray, xyz: tuple[np.ndarray, ...], rgb: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int64)), *map(pa.array, xyz), *(pa.array(c.astype(np.int16)) for c in rgb)], ["idx", "x", "y", "z", "r", "g", "b"])


@dataclass
class LasHeader:
    version: tuple[int, int]
    data_at: int
    point_format: int
    record: int
    count: int
    compressed: bool
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]


def las_header(head: bytes) -> LasHeader:
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    size, at, kind, record, count = struct.unpack_from("<HIxxxxBHI", head, 94)
    if head[25] >= 4 and size >= 375 and len(head) >= 255:
        count = struct.unpack_from("<Q", head, 247)[0] or count
    numbers = struct.unpack_from("<12d", head, 131)
    return LasHeader((head[24], head[25]), at, kind & 0x3F, record, count, bool(kind & 0xC0), numbers[:3], numbers[3:6], numbers[7::2], numbers[6::2])


def _rgb_shift(f, h: LasHeader, size: int, step: int) -> int:
    """8 if about 2000 sampled colours show 16 bits, else 0; one answer for the whole file."""
    at = RGB_OFFSET.get(h.point_format)
    if at is None:
        return 0
    for i in range(0, h.count, max(step, math.ceil(h.count / 2000), 1)):
        p = h.data_at + i * h.record + at
        if p + 6 > size:
            break
        f.seek(p)
        if max(struct.unpack("<3H", f.read(6))) > 255:
            return 8
    return 0


@dataclass
class Range(InputPartition):
    """Records of a file; scan: of which scan, in LAS files how far colours are shifted."""

    first: int
    end: int
    file: int = 0
    scan: int = 0


@dataclass
class Files(InputPartition):
    paths: list[str]


class InfoReader(DataSourceReader):
    """Points and boxes of files or scans, from headers alone; files are dealt to tasks."""

    def __init__(self, options: dict, suffix: str) -> None:
        self.paths, self.suffix = _files(options["path"], suffix), suffix

    def partitions(self) -> list[Files]:
        return [Files(self.paths[i : i + 64]) for i in range(0, len(self.paths), 64)] or [Files([])]

    def read(self, p: Files) -> Iterator[tuple]:
        for path in p.paths:
            with _open(path) as f:
                if self.suffix == ".las":
                    h = las_header(f.read(375))
                    yield (path, 0, h.count, *h.low, *h.high)
                else:
                    for k, s in enumerate(e57_scans(f)):
                        yield (path, k, s.count, *[None] * 6)


def _info(options: dict) -> bool:
    return str(options.get("info", "false")).lower() == "true"


def _files(path: str, suffix: str) -> list[str]:
    """The addresses of the files that a path names, in order."""
    fs, at = _system(path)
    folder, name = at.rpartition("/")[::2]
    if any(c in name for c in "*?["):
        found = [i.path for i in fs.get_file_info(FileSelector(folder)) if i.type == FileType.File and fnmatch.fnmatchcase(i.base_name, name)]
    elif fs.get_file_info(at).type == FileType.Directory:
        found = [i.path for i in fs.get_file_info(FileSelector(at, recursive=True)) if i.type == FileType.File and i.base_name.lower().endswith(suffix)]
    else:
        return [path]
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [scheme + x for x in sorted(found)]


def _system(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def _open(path: str):
    fs, at = _system(path)
    return fs.open_input_file(at)


def _options(options: dict, suffix: str) -> tuple[list[str], int, tuple[float, float, float] | None, bool]:
    origin = options.get("origin")
    return _files(options["path"], suffix), int(options.get("max_points", 0)), tuple(map(float, origin.split(","))) if origin else None, str(options.get("swizzle", "true")).lower() == "true"


@dataclass
class Bounds:
    """The least and greatest value that the filters of each column let pass; they stay with Spark, which applies them to all rows."""

    of: dict[str, list[float]] = field(default_factory=dict)

    def add(self, filters: Iterable[Filter]) -> None:
        for x in filters:
            name, value = getattr(x, "attribute", ("",)), getattr(x, "value", None)
            values = list(value) if isinstance(x, In) else [value]
            if len(name) != 1 or not values or not all(isinstance(v, (int, float)) for v in values):
                continue
            own = self.of.setdefault(name[0], [-math.inf, math.inf])
            if isinstance(x, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                own[0] = max(own[0], min(values))
            if isinstance(x, (EqualTo, In, LessThan, LessThanOrEqual)):
                own[1] = min(own[1], max(values))

    def clipped(self, first: int, end: int) -> tuple[int, int]:
        """The part of a range of idx that may pass."""
        low, high = self.of.get("idx", (-math.inf, math.inf))
        return max(first, math.ceil(low) if low > -math.inf else first), min(end, math.floor(high) + 1 if high < math.inf else end)

    def miss(self, low: tuple[float, ...], high: tuple[float, ...]) -> bool:
        """Whether no point of a box in the rows' coordinates can pass; floats are rounded outwards."""
        for a, lo, hi in zip("xyz", low, high, strict=True):
            least, most = self.of.get(a, (-math.inf, math.inf))
            slack = 1e-6 * max(abs(lo), abs(hi), 1.0)
            if hi + slack < least or lo - slack > most:
                return True
        return False


class PointReader(DataSourceReader):
    """What both formats share: filters that leave out partitions."""

    bounds: Bounds

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        self.bounds.add(filters)
        return filters


def _heads(paths: list[str], read) -> list:
    """What read makes of each open file, some files at a time."""

    def one(path: str):
        with _open(path) as f:
            return read(f)

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(one, paths))


class LasReader(PointReader):
    def __init__(self, options: dict) -> None:
        self.paths, most, origin, self.swizzle = _options(options, ".las")
        self.origin = origin or (0.0, 0.0, 0.0)
        self.heads: list[LasHeader] = _heads(self.paths, lambda f: las_header(f.read(375)))
        if any(h.compressed for h in self.heads):
            raise ValueError("compressed LAS files must be decompressed first")
        self.step = step_for(sum(h.count for h in self.heads), most)
        self.starts = np.cumsum([0, *(h.count for h in self.heads)]).tolist()
        self.bounds = Bounds()

    def _box_missed(self, h: LasHeader) -> bool:
        """Whether the header's box, if it has one, is outside of what the filters on coordinates let pass."""
        if not all(a <= b for a, b in zip(h.low, h.high, strict=True)) or not any((*h.low, *h.high)):
            return False
        corners = placed(*(np.array(v) + np.array([-1, 1]) * 2 * k for v, k in zip(zip(h.low, h.high, strict=True), h.scale, strict=True)), self.origin, self.swizzle)
        return self.bounds.miss(tuple(float(c.min()) for c in corners), tuple(float(c.max()) for c in corners))

    def partitions(self) -> list[Range]:
        left = [k for k, h in enumerate(self.heads) if not self._box_missed(h)]

        def looked_at(k: int) -> tuple[int, int]:
            h = self.heads[k]
            with _open(self.paths[k]) as f:
                size = f.size()
                # Records whose coordinates are there in full.
                there = min(h.count, max(0, (size - h.data_at - 12) // h.record + 1) if size >= h.data_at + 12 else 0)
                return there, _rgb_shift(f, h, size, self.step)

        out = []
        with ThreadPoolExecutor(16) as pool:
            for k, (n, shift) in zip(left, pool.map(looked_at, left), strict=True):
                first, end = (v - self.starts[k] for v in self.bounds.clipped(self.starts[k], self.starts[k] + n))
                out += [Range(i, min(i + PART, end), k, shift) for i in range(max(first, 0), end, PART)]
        return out or [Range(0, 0)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        if p.first == p.end:
            return
        h, shift, before = self.heads[p.file], p.scan, self.starts[p.file]
        at = RGB_OFFSET.get(h.point_format)
        with _open(self.paths[p.file]) as f:
            for lo in range(p.first, p.end, BATCH):
                hi = min(lo + BATCH, p.end)
                f.seek(h.data_at + lo * h.record)
                raw = f.read((hi - lo) * h.record)
                rows = np.frombuffer(raw.ljust((hi - lo) * h.record, b"\0"), np.uint8).reshape(-1, h.record)
                idx = np.arange(lo, hi) + before
                keep = idx % self.step == 0
                rows, idx = rows[keep], idx[keep]
                xyz = np.ascontiguousarray(rows[:, :12]).view("<i4").astype(np.float64) * h.scale + h.offset
                if at is None:
                    rgb = (np.full(len(idx), GREY),) * 3
                else:
                    rgb = tuple((np.ascontiguousarray(rows[:, at : at + 6]).view("<u2") >> shift & 255).T)
                yield batch(idx, placed(*xyz.T, self.origin, self.swizzle), rgb)


def las_bytes(xyz: np.ndarray, rgb: np.ndarray, scale: float) -> bytes:
    """A LAS 1.2 file of format 2; coordinates are rounded to the scale, from an offset at their middle."""
    n = len(xyz)
    low, high = (f(xyz, axis=0) if n else np.zeros(3) for f in (np.min, np.max))
    offset = np.floor((low + high) / 2)
    if n and np.abs(xyz - offset).max() / scale >= 2**31:
        raise ValueError("the points span more than the scale allows")
    rows = np.zeros(n, np.dtype([("at", "<i4", 3), ("other", "V8"), ("rgb", "<u2", 3)]))
    rows["at"], rows["rgb"] = np.rint((xyz - offset) / scale), rgb
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 2, rows.itemsize, n)
    struct.pack_into("<12d", head, 131, *(scale,) * 3, *offset, high[0], low[0], high[1], low[1], high[2], low[2])
    return bytes(head) + rows.tobytes()


class PointWriter(DataSourceArrowWriter):
    """Each Arrow batch becomes a file, whose name begins with this write's own mark; those of its failed tasks go when it ends."""

    suffix = ".las"

    def __init__(self, options: dict, schema, overwrite: bool = False) -> None:
        self.path, self.scale, self.names = options["path"], float(options.get("scale", 0.001)), schema.fieldNames()
        self.mark, self.overwrite = f"part-{uuid.uuid4().hex}-", overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = _system(self.path)
        fs.create_dir(at, recursive=True)
        made = []
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            xyz = np.stack([column(c).astype(float) for c in "xyz"], 1)
            sound = np.isfinite(xyz).all(1)
            rgb = np.stack([np.nan_to_num(column(c).astype(float)) for c in "rgb"], 1) if {"r", "g", "b"} <= set(self.names) else np.full(xyz.shape, GREY)
            made.append(f"{self.mark}{uuid.uuid4().hex}{self.suffix}")
            with fs.open_output_stream(f"{at}/{made[-1]}") as f:
                f.write(self.encoded(xyz[sound], rgb[sound]))
        return Written(made)

    def _remove(self, which) -> None:
        fs, at = _system(self.path)
        fs.create_dir(at, recursive=True)
        for i in fs.get_file_info(FileSelector(at)):
            if i.type == FileType.File and which(i.base_name):
                fs.delete_file(i.path)

    def commit(self, messages: list) -> None:
        """Of this write only what the tasks that count have written stays; files of other writes stay, unless they are to be overwritten."""
        own = {name for m in messages if m for name in m.names}
        self._remove(lambda name: name not in own and (name.startswith(self.mark) or self.overwrite and name.lower().endswith(self.suffix)))

    def abort(self, messages: list) -> None:
        self._remove(lambda name: name.startswith(self.mark))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class LasWriter(PointWriter):
    def encoded(self, xyz: np.ndarray, rgb: np.ndarray) -> bytes:
        return las_bytes(xyz, rgb, self.scale)


class Las(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return INFO if _info(self.options) else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return InfoReader(self.options, ".las") if _info(self.options) else LasReader(self.options)

    def writer(self, schema, overwrite: bool) -> LasWriter:
        return LasWriter(self.options, schema, overwrite)


@dataclass
class Field:
    name: str
    kind: str
    bits: int
    low: int = 0
    scale: float = 1.0
    offset: float = 0.0

    def decode(self, stream: np.ndarray, first_bit: int, n: int) -> np.ndarray:
        """n values that start at a bit of a byte stream, least significant bit first."""
        if self.kind == "Float":
            return np.frombuffer(stream.tobytes(), "<f4" if self.bits == 32 else "<f8", n, first_bit // 8).astype(np.float64)
        if not self.bits:
            raw = np.zeros(n)
        else:
            a, b = first_bit // 8, -(-(first_bit + n * self.bits) // 8)
            bits = np.unpackbits(stream[a:b], bitorder="little")[first_bit % 8 :][: n * self.bits].reshape(n, self.bits)
            raw = bits @ (2.0 ** np.arange(self.bits))
        value = raw + self.low
        return value * self.scale + self.offset if self.kind == "ScaledInteger" else value


@dataclass
class Scan:
    at: int
    count: int
    fields: list[Field]
    pose: tuple[float, ...]
    first: int = 0


@dataclass
class E57Header:
    version: tuple[int, int]
    length: int
    xml_at: int
    xml_length: int
    page: int


def e57_header(head: bytes) -> E57Header:
    if head[:8] != b"ASTM-E57":
        raise ValueError("not an E57 file")
    major, minor, length, at, n, page = struct.unpack_from("<IIQQQQ", head, 8)
    return E57Header((major, minor), length, at, n, page or 1024)


class Pages:
    """Logical bytes of a paged file: each page ends in a checksum of four bytes, which is skipped."""

    def __init__(self, f, page: int) -> None:
        self.f, self.page = f, page

    def logical(self, physical: int) -> int:
        return physical // self.page * (self.page - 4) + physical % self.page

    def read(self, at: int, n: int) -> bytes:
        if n <= 0:
            return b""
        own = self.page - 4
        first, last = at // own, (at + n - 1) // own
        self.f.seek(first * self.page)
        raw = self.f.read((last - first + 1) * self.page)
        raw = np.frombuffer(raw.ljust((last - first + 1) * self.page, b"\0"), np.uint8).reshape(-1, self.page)[:, :own].ravel()
        return raw[at - first * own : at - first * own + n].tobytes()


def _tag(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _find(node: ET.Element | None, name: str) -> ET.Element | None:
    return next((c for c in node if _tag(c) == name), None) if node is not None else None


def _number(node: ET.Element | None, name: str, default: float) -> float:
    c = _find(node, name)
    return float(c.text) if c is not None and c.text and c.text.strip() else default


def _fields(prototype: ET.Element) -> list[Field]:
    out = []
    for c in prototype:
        kind = c.get("type", "")
        if kind == "Float":
            out.append(Field(_tag(c), kind, 32 if c.get("precision") == "single" else 64))
        else:
            low, high = int(float(c.get("minimum", 0))), int(float(c.get("maximum", 0)))
            out.append(Field(_tag(c), kind, (high - low).bit_length() if high > low else 0, low, float(c.get("scale", 1)), float(c.get("offset", 0))))
    return out


def e57_scans(f) -> list[Scan]:
    """The scans of a file in document order, from its header and XML only."""
    f.seek(0)
    h = e57_header(f.read(48))
    pages = Pages(f, h.page)
    root = ET.fromstring(pages.read(pages.logical(h.xml_at), h.xml_length))
    scans: list[Scan] = []
    for node in _find(root, "data3D") if _find(root, "data3D") is not None else ():
        points = _find(node, "points")
        if points is None:
            continue
        pose = _find(node, "pose")
        turn, move = _find(pose, "rotation"), _find(pose, "translation")
        q = [_number(turn, k, 1.0 if k == "w" else 0.0) for k in "wxyz"]
        t = [_number(move, k, 0.0) for k in "xyz"]
        first = scans[-1].first + scans[-1].count if scans else 0
        scans.append(Scan(int(points.get("fileOffset", 0)), int(points.get("recordCount", 0)), _fields(_find(points, "prototype")), (*q, *t), first))
    return scans


def e57_point_count(path: str) -> int:
    """Points of a file by its metadata; nothing is decoded."""
    with _open(path) as f:
        return sum(s.count for s in e57_scans(f))


@dataclass
class Spot:
    """Where to go on in a scan: the packet at a place, and how many bytes of each field come before it."""

    at: int
    before: list[int]


def packets(f, page: int, scan: Scan, start: Spot | None = None) -> Iterator[tuple[Spot, int, list[int]]]:
    """(the packet, place of its first stream, bytes of each field's stream) of a scan's data packets, one after another; only their heads are read."""
    pages = Pages(f, page)
    section_at = pages.logical(scan.at)
    section = pages.read(section_at, 32)
    if section[0] != 1:
        raise ValueError("a compressed vector section was expected")
    length, data_at = struct.unpack_from("<QQ", section, 8)
    start = start or Spot(pages.logical(data_at), [0] * len(scan.fields))
    at, before, end = start.at, list(start.before), section_at + length
    while at + 6 <= end:
        kind, size, streams = struct.unpack("<BxHH", pages.read(at, 6))
        if kind == 1:
            sizes = np.frombuffer(pages.read(at + 6, 2 * streams), "<u2").astype(int).tolist()
            yield Spot(at, list(before)), at + 6 + 2 * streams, sizes
            before = [b + (sizes[k] if k < len(sizes) else 0) for k, b in enumerate(before)]
        elif kind not in (0, 2):
            return
        at += size + 1


def complete(held: list[int], scan: Scan) -> int:
    """Records that are there on all fields, of so many bytes of each."""
    return min([scan.count, *(8 * n // x.bits for n, x in zip(held, scan.fields, strict=True) if x.bits)])


def chunks(f, page: int, scan: Scan, size: int) -> Iterator[tuple[int, int, Spot]]:
    """(first record, end, where to start) of ranges of at least size records, by one walk over the packets.

    Only the packets since the last range's start are remembered.
    """
    recent: deque[Spot] = deque()
    held = [0] * len(scan.fields)
    first = 0
    for spot, _, sizes in packets(f, page, scan):
        recent.append(spot)
        held = [n + (sizes[k] if k < len(sizes) else 0) for k, n in enumerate(held)]
        there = complete(held, scan)
        while there - first >= size:
            yield first, first + size, _start(recent, scan, first)
            first += size
    there = complete(held, scan)
    if there > first:
        yield first, there, _start(recent, scan, first)


def _start(recent: deque[Spot], scan: Scan, first: int) -> Spot:
    """The last packet before which no field has reached record first; earlier ones are forgotten."""
    while len(recent) > 1 and all(b * 8 <= first * x.bits for b, x in zip(recent[1].before, scan.fields, strict=True)):
        recent.popleft()
    return recent[0]


def records(f, page: int, scan: Scan, first: int = 0, end: int | None = None, start: Spot | None = None) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(first record, columns) of records first to end that are complete on all fields, some packets at a time.

    A field's streams follow each other as one, so record i begins at its bit
    i * bits; a packet's streams are skipped up to that bit and read from there.
    """
    pages = Pages(f, page)
    end = scan.count if end is None else min(end, scan.count)
    held = [np.zeros(0, np.uint8) for _ in scan.fields]
    bit = [first * x.bits % 8 for x in scan.fields]
    skip = [first * x.bits // 8 for x in scan.fields]
    if start:
        skip = [n - b for n, b in zip(skip, start.before, strict=True)]
    done = first
    for _, at, sizes in packets(f, page, scan, start):
        if done >= end:
            return
        for k, size in enumerate(sizes[: len(held)]):
            gone = min(skip[k], size)
            skip[k] -= gone
            if size > gone:
                held[k] = np.concatenate([held[k], np.frombuffer(pages.read(at + gone, size - gone), np.uint8)])
            at += size
        n = min([end - done, *((len(b) * 8 - o) // x.bits for b, o, x in zip(held, bit, scan.fields, strict=True) if x.bits)])
        if n > 0:
            yield done, {x.name: x.decode(b, o, n) for b, o, x in zip(held, bit, scan.fields, strict=True)}
            for k, x in enumerate(scan.fields):
                used = bit[k] + n * x.bits
                held[k], bit[k] = held[k][used // 8 :], used % 8
            done += n


def posed(x: np.ndarray, y: np.ndarray, z: np.ndarray, pose: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """Points turned by a unit quaternion and moved."""
    w, a, b, c, *move = pose
    turn = np.array([[1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)], [2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)], [2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)]])
    return tuple(turn @ np.stack([x, y, z]) + np.array(move)[:, None])


def _first_point(f, page: int, scan: Scan) -> tuple[float, ...] | None:
    """The first point of a scan, each coordinate rounded half up."""
    first = next(iter(records(f, page, scan, 0, 1)), None) if scan.count else None
    return tuple(float(np.floor(v[0] + 0.5)) for v in posed(*(first[1].get(f"cartesian{a}", np.zeros(1))[:1] for a in "XYZ"), scan.pose)) if first else None


def e57_batches(f, page: int, scan: Scan, before: int, first: int, end: int, start: Spot | None, step: int, origin: tuple[float, float, float], swizzle: bool) -> Iterator[pa.RecordBatch]:
    """Points of records first to end; before: points of the scans before."""
    for at, cols in records(f, page, scan, first, end, start):
        n = len(next(iter(cols.values())))
        idx = np.arange(at, at + n) + before
        keep = idx % step == 0
        xyz = posed(*(cols.get(f"cartesian{a}", np.zeros(n))[keep] for a in "XYZ"), scan.pose)
        rgb = tuple((cols[k][keep].astype(np.int64) & 255) if (k := f"color{c}") in cols else np.full(int(keep.sum()), GREY) for c in ("Red", "Green", "Blue"))
        yield batch(idx[keep], placed(*xyz, origin, swizzle), rgb)


class E57Reader(PointReader):
    """Planning reads headers and XML, and one packet for the origin; a task walks over the heads of the packets before its range."""

    def __init__(self, options: dict) -> None:
        self.paths, most, self.origin, self.swizzle = _options(options, ".e57")
        self.scans: list[tuple[int, int, int, Scan]] = []  # file, page, first index, scan
        self.bounds = Bounds()
        total = 0
        for k, path in enumerate(self.paths):
            with _open(path) as f:
                page = e57_header(f.read(48)).page
                for s in e57_scans(f):
                    self.origin = self.origin or _first_point(f, page, s)
                    self.scans.append((k, page, total, s))
                    total += s.count
        if not total:
            raise ValueError("no points")
        self.step = step_for(total, most)
        self.origin = self.origin or (0.0, 0.0, 0.0)

    def partitions(self) -> list[Range]:
        out = []
        for k, (_, _, before, s) in enumerate(self.scans):
            first, end = (v - before for v in self.bounds.clipped(before, before + s.count))
            out += [Range(i, min(i + PART, end), scan=k) for i in range(max(first, 0), end, PART)]
        return out or [Range(0, 0)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        if p.first == p.end:
            return
        k, page, before, s = self.scans[p.scan]
        with _open(self.paths[k]) as f:
            yield from e57_batches(f, page, s, before, p.first, p.end, None, self.step, self.origin, self.swizzle)


def read_e57(spark: SparkSession, path: str, max_points: int = 0, origin: tuple[float, float, float] | None = None, swizzle: bool = True, size: int | None = None) -> DataFrame:
    """The rows of format("e57"), in two stages that run in tasks; the driver knows names of files only.

    First each scan is found from its file's header and XML, and its packets are followed
    once, which leaves a row for every range of size records; these rows are
    written, dealt out, and decoded from where they say. origin: by default the first
    point of the first scan.
    """
    from trussline.functions.scratch import checkpointed

    size = size or PART
    paths = _files(path, ".e57")
    files = spark.createDataFrame(list(enumerate(paths)), "file int, path string").repartition(max(len(paths), 1))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _open(name) as f:
                    page = e57_header(f.read(48)).page
                    rows += [(k, name, i, page, s.count, json.dumps(asdict(s)), _first_point(f, page, s)) for i, s in enumerate(e57_scans(f))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "path", "scan", "page", "count", "of", "at"])

    scans = files.mapInArrow(found, "file int, path string, scan int, page long, count long, of string, at array<double>")
    # One row a scan: running sums over them show where each one's points begin.
    order = Window.orderBy("file", "scan").rowsBetween(Window.unboundedPreceding, -1)
    scans = checkpointed(scans.withColumn("before", F.coalesce(F.sum("count").over(order), F.lit(0))))
    total, first = scans.agg(F.sum("count"), F.min_by("at", F.when(F.col("at").isNotNull(), F.struct("file", "scan")))).first()
    step, base = step_for(total or 0, max_points), tuple(origin or first or (0.0, 0.0, 0.0))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, page, of, before in zip(*(b.column(c).to_pylist() for c in ("path", "page", "of", "before")), strict=True):
                with _open(name) as f:
                    for lo, hi, spot in chunks(f, page, _scan(of), size):
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, page, of, before, lo, hi, spot.at, spot.before)], ["path", "page", "of", "before", "first", "end", "at", "held"])

    ranges = scans.where("count > 0").repartition("file", "scan").mapInArrow(indexed, "path string, page long, of string, before long, first long, end long, at long, held array<long>")
    ranges = checkpointed(ranges)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, page, of, before, lo, hi, at, held in zip(*(b.column(c).to_pylist() for c in ("path", "page", "of", "before", "first", "end", "at", "held")), strict=True):
                with _open(name) as f:
                    yield from e57_batches(f, page, _scan(of), before, lo, hi, Spot(at, held), step, base, swizzle)

    return ranges.repartition("path", "before", "first").mapInArrow(decoded, SCHEMA)


def _scan(text: str) -> Scan:
    of = json.loads(text)
    return Scan(**of | {"fields": [Field(**x) for x in of["fields"]], "pose": tuple(of["pose"])})


def _checksums(pages: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes, all rows at once, as big-endian bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    crc = np.full(len(pages), 0xFFFFFFFF, np.uint32)
    for k in range(pages.shape[1]):
        crc = table[(crc ^ pages[:, k]) & 255] ^ (crc >> 8)
    return (~crc).astype(">u4").view(np.uint8).reshape(-1, 4)


def e57_bytes(xyz: np.ndarray, rgb: np.ndarray, page: int = 1024) -> bytes:
    """An E57 file of one scan: coordinates as doubles, colours (0 to 255) as bytes, in packets below 64 KB."""
    own, n, most = page - 4, len(xyz), 2048
    physical = lambda at: at // own * page + at % own
    packets_ = b""
    for i in range(0, n, most):
        streams = [np.ascontiguousarray(xyz[i : i + most, k], "<f8").tobytes() for k in range(3)] + [np.ascontiguousarray(rgb[i : i + most, k]).astype(np.uint8).tobytes() for k in range(3)]
        body = struct.pack("<6H", *map(len, streams)) + b"".join(streams)
        body += bytes(-(len(body) + 6) % 4)
        packets_ += struct.pack("<BBHH", 1, 0, len(body) + 5, 6) + body
    section = struct.pack("<B7xQQQ", 1, 32 + len(packets_), physical(48 + 32), 0) + packets_
    fields = "".join(f'<cartesian{a} type="Float"/>' for a in "XYZ") + "".join(f'<color{c} type="Integer" minimum="0" maximum="255"/>' for c in ("Red", "Green", "Blue"))
    scan = f'<vectorChild type="Structure"><points type="CompressedVector" fileOffset="{physical(48)}" recordCount="{n}"><prototype type="Structure">{fields}</prototype></points></vectorChild>'
    text = f'<?xml version="1.0" encoding="UTF-8"?><e57Root type="Structure" xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><formatName type="String">ASTM E57 3D Imaging Data File</formatName><data3D type="Vector" allowHeterogeneousChildren="1">{scan}</data3D></e57Root>'.encode()
    at = 48 + len(section)
    size = -(-(at + len(text)) // own)
    head = b"ASTM-E57" + struct.pack("<IIQQQQ", 1, 0, size * page, physical(at), len(text), page)
    rows = np.frombuffer((head + section + text).ljust(size * own, b"\0"), np.uint8).reshape(size, own)
    return np.concatenate([rows, _checksums(rows)], 1).tobytes()


class E57Writer(PointWriter):
    suffix = ".e57"

    def encoded(self, xyz: np.ndarray, rgb: np.ndarray) -> bytes:
        return e57_bytes(xyz, rgb)


class E57(DataSource):
    @classmethod
    def name(cls) -> str:
        return "e57"

    def schema(self) -> str:
        return INFO if _info(self.options) else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return InfoReader(self.options, ".e57") if _info(self.options) else E57Reader(self.options)

    def writer(self, schema, overwrite: bool) -> E57Writer:
        return E57Writer(self.options, schema, overwrite)


def register(spark) -> None:
    """Makes both formats known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Las)
    spark.dataSource.register(E57)
