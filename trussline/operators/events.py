"""Usage events: from controls and files to event names, once per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event of a control's id (fixed values).
EVENTS = {
    "btnAlign": "alignment",
    "btnSection": "section",
    "btnSecDraw": "section-draw",
    "btnWalk": "walk",
    "btnQtoRun": "qto-run",
    "btnQtoCsv": "qto-csv",
    "btnClashRun": "clash-run",
    "btnClashMtxRun": "clash-matrix",
    "btnClashCsv": "clash-csv",
    "btnClashBcf": "clash-bcf",
    "btnIdsRun": "ids-run",
    "btnIdsExportBcf": "ids-bcf",
    "btnC2dRun": "cloud-distance",
    "btnC2mScan": "cloud-scan",
    "btnExportBcf": "bcf-export",
    "btnReportStats": "report-stats",
    "btnRepExport": "report-export",
}
#: Event of a file by its ending, and by the input that it came through (fixed values).
FILE_KINDS = (
    (r"\.ifc$", "ifc-open"),
    (r"\.(bcf|bcfzip|zip)$", "bcf-open"),
    (r"\.(xlsx|xlsm)$", "report-open"),
    (r"\.(las|laz|e57)$", "pointcloud-open"),
    (r"\.ids$", "ids-open"),
    (r"\.(xml|landxml)$", "landxml-open"),
)
#: Events that a session holds back until the sink is ready, at most.
QUEUE = 20
BY_INPUT = {"fileC2mBook": "cloud-codebook", "fileClashMtx": "clash-matrix-load"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def control_event(element_id: Column, names: dict[str, str] = EVENTS) -> Column:
    """The event of a control, or null."""
    return _lookup(names, element_id)


def file_kind(name: Column, input_id: Column | None = None, kinds: tuple[tuple[str, str], ...] = FILE_KINDS) -> Column:
    """The event of a file: its input's, or that of the first ending that fits, or null."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(kinds):
        out = F.when(F.regexp_like(name, F.lit(r"(?i)" + pattern.replace("$", r"\z"))), kind).otherwise(out)
    return out if input_id is None else F.coalesce(_lookup(BY_INPUT, input_id), out)


def session_events(clicks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(session_id, ts, event) of known controls and files, from (session_id, ts, element_id) and (session_id, ts, file_name, element_id)."""
    out = clicks.select("session_id", "ts", control_event(F.col("element_id")).alias("event"))
    if files is not None:
        out = out.unionByName(files.select("session_id", "ts", file_kind(F.col("file_name"), F.col("element_id")).alias("event")))
    return out.where("event is not null")


def allowed(events: DataFrame, host: str = "host", protocol: str = "protocol", do_not_track: str = "dnt") -> DataFrame:
    """Without events of local hosts, files, and users who opted out."""
    local = F.col(host).isin("localhost", "127.0.0.1", "") | F.col(host).isNull() | ~F.col(protocol).isin("http:", "https:")
    return events.where(~local & ~F.coalesce(F.col(do_not_track), F.lit(False)))


def first_of_session(events: DataFrame) -> DataFrame:
    """The first occurrence of each event in a session."""
    return events.groupBy("session_id", "event").agg(F.min("ts").alias("ts"))


def delivered(events: DataFrame, signals: DataFrame, most: int = QUEUE) -> DataFrame:
    """(session_id, event, ts, sent_at, seq): what reaches the sink, in order, of (session_id, ts, event) and (session_id, ts, signal).

    An event counts once a session. Until the session's first signal "ready" the first most
    events are held; a signal "failed" before that drops what is held, and "ready" sends it, in order. Later events go
    at once; what was not held is lost. Of one time, signals come first, then events by name.
    A session has as many rows here as there are names.
    """
    first = first_of_session(events)
    ready = signals.where("signal = 'ready'").groupBy("session_id").agg(F.min("ts").alias("ready"))
    failed = signals.where("signal = 'failed'").join(ready, "session_id").where("ts <= ready").groupBy("session_id").agg(F.max("ts").alias("failed"))
    rows = first.join(ready, "session_id").join(failed, "session_id", "left")
    held = (F.col("ts") < F.col("ready")) & (F.col("failed").isNull() | (F.col("ts") >= F.col("failed")))
    at = F.row_number().over(Window.partitionBy("session_id", "held").orderBy("ts", "event"))
    sent = rows.withColumn("held", held).withColumn("at", at).where((F.col("ts") >= F.col("ready")) | (F.col("held") & (F.col("at") <= most)))
    sent_at = F.greatest("ts", "ready")
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("sent_at", "ts", "event"))
    return sent.withColumn("sent_at", sent_at).select("session_id", "event", "ts", "sent_at", seq.cast("int").alias("seq"))
