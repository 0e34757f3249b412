"""Building models in STEP text (``#12=IFCWALL('guid',#5,...);``) as tables of records.

A large file is read by byte ranges, whatever they cut through. Whether a range
begins inside a string or a comment depends on all that comes before it, so a
first job says of each range which state each possible state at its start turns
into, and these few numbers are composed along the file; the second job
reads the records of its range from the state that it really starts in, and the
last one to its end beyond the range. So any split gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions.scratch import checkpointed
from trussline.sources.pointclouds import _files, _open

RECORDS = "file string, id long, entity string, args string, refs array<long>"
#: Bytes of a range, and bytes that are read at once.
RANGE, READ = 64 << 20, 1 << 20
#: Bytes that are read beyond a range at first.
TAIL = 4 << 10
#: States: plain text, in a string, in a comment, after a slash in plain text, after a star in a comment.
PLAIN, TEXT, COMMENT, SLASH, STAR = range(5)
_STEPS = {PLAIN: {39: TEXT, 47: SLASH}, TEXT: {39: PLAIN}, COMMENT: {42: STAR}, SLASH: {39: TEXT, 42: COMMENT, 47: SLASH}, STAR: {47: PLAIN, 42: STAR}}
_AFTER = {PLAIN: PLAIN, TEXT: TEXT, COMMENT: COMMENT, SLASH: PLAIN, STAR: COMMENT}
_RECORD = re.compile(rb"\s*#(\d+)\s*=\s*([A-Za-z0-9_]*)\s*\((.*)\)\s*\Z", re.S)
_COMMENT = re.compile(rb"'[^']*'|/\*.*?\*/", re.S)
_STRING, _REF = re.compile(rb"'[^']*'"), re.compile(rb"#(\d+)")


#: Whole strings and comments and what is between them; the same up to the end of a record.
_WHOLE = re.compile(rb"(?:[^'/]++|'[^']*+'|/(?=[^*])|/\*(?s:.*?)\*/)*+")
_ENDED = re.compile(rb"(?:[^'/;]++|'[^']*+'|/(?=[^*])|/\*(?s:.*?)\*/)*+;")


def _plain(data: bytes, state: int) -> int:
    """Where plain text begins if a state is that at the start, or -1 if it doesn't."""
    if state == TEXT:
        return data.find(b"'") + 1 or -1
    if state == STAR and data[:1] == b"/":
        return 1
    if state == SLASH and data[:1] == b"*" or state in (COMMENT, STAR):
        at = data.find(b"*/", int(state == SLASH))
        return at + 2 if at >= 0 else -1
    return 0


def _left(data: bytes, first: int) -> int:
    """The state after plain text from first on."""
    at = _WHOLE.match(data, first).end()
    if at == len(data):
        return PLAIN
    if data[at] == 39:
        return TEXT
    return SLASH if at + 1 == len(data) else STAR if data.endswith(b"*", at + 2) else COMMENT


def walk(data: bytes, state: int) -> int:
    """The state after some bytes."""
    if not data:
        return state
    first = _plain(data, state)
    if first >= 0:
        return _left(data, first) if first < len(data) else PLAIN
    if state == TEXT:
        return TEXT
    return STAR if data.endswith(b"*", int(state == SLASH)) else COMMENT


def ends(data: bytes, state: int) -> tuple[list[int], int]:
    """Places of the semicolons that end a record, and the state after."""
    out, first = [], _plain(data, state) if data else -1
    if first < 0:
        return out, walk(data, state)
    while m := _ENDED.match(data, first):
        first = m.end()
        out.append(first - 1)
    return out, _left(data, first) if first < len(data) else PLAIN


def _without_comments(raw: bytes) -> bytes:
    if b"/*" not in raw:
        return raw
    return _COMMENT.sub(lambda m: m[0] if m[0][:1] == b"'" else b" ", raw)


def record(raw: bytes) -> tuple[int, str, str, list[int]] | None:
    """(id, entity, arguments, references) of a record's text; null for what is none. References in strings are text."""
    m = _RECORD.match(_without_comments(raw))
    if not m:
        return None
    args = m[3].strip()
    return int(m[1]), m[2].decode().upper(), args.decode("utf-8", "replace"), [int(x) for x in _REF.findall(_STRING.sub(b"", args))]


def records(f, first: int, end: int, state: int) -> Iterator[tuple[int, str, str, list[int]]]:
    """The records that follow a border inside first to end; the start of the file is one, too."""
    f.seek(first)
    held, at, open_, more = b"", first, first == 0, TAIL
    while True:
        # Of what is beyond the range only the end of one record is wanted.
        if at >= end:
            data, more = f.read(min(READ, more)), more * 2
        else:
            data = f.read(min(READ, end - at))
        if not data:
            return
        borders, state = ends(data, state)
        begin = 0
        for b in borders:
            if open_:
                one = record(held + data[begin:b])
                if one:
                    yield one
            held, begin = b"", b + 1
            if at + b >= end:  # what follows is the next range's
                return
            open_ = True
        if open_:
            held += data[begin:]
        at += len(data)
        if not open_ and at >= end:
            return


def read_step(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """file, id, entity, args (text between the outer brackets) and refs of all records of a file, folder or pattern (.ifc); headers are no records."""
    names = _files(path, ".ifc")
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(len(names), 1))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with _open(name) as f:
                    n = f.size()
                at = list(range(0, n, size))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array([min(a + size, n) for a in at], pa.int64())], ["file", "first", "end"])

    ranges = checkpointed(files.mapInArrow(dealt, "file string, first long, end long"))
    # So many tasks in any case: rows that name ranges are small, and Spark would put them together into one.
    n, total = ranges.agg(F.count("*"), F.sum(F.col("end") - F.col("first"))).first()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // RANGE))))
    ranges = ranges.repartition(tasks, "file", "first")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = []
            for name, first, end in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                states = list(range(5))
                with _open(name) as f:
                    f.seek(first)
                    for at in range(first, end, READ):
                        data = f.read(min(READ, end - at))
                        after = {s: walk(data, s) for s in set(states)}
                        states = [after[s] for s in states]
                turns.append(states)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(turns, pa.list_(pa.int32()))], ["file", "first", "end", "turn"])

    def started(frame: pd.DataFrame) -> pd.DataFrame:
        """One row for each range of a file: five small numbers."""
        frame, state, out = frame.sort_values("first"), PLAIN, []
        for turn in frame.turn:
            out.append(state)
            state = int(turn[state])
        return frame[["file", "first", "end"]].assign(state=out)

    begun = checkpointed(ranges.mapInArrow(walked, "file string, first long, end long, turn array<int>").groupBy("file").applyInPandas(started, "file string, first long, end long, state int"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "id", "entity", "args", "refs"])

        for b in batches:
            for name, first, end, state in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows = []
                with _open(name) as f:
                    for one in records(f, first, end, state):
                        rows.append((name, *one))
                        if len(rows) == 10_000:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    return begun.repartition(tasks, "file", "first").mapInArrow(read, RECORDS)
