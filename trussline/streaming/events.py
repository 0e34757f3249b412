"""The event operators over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trussline.operators.events import QUEUE


def once_per_session(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event of a session once, of a stream of (session_id, ts, event); state goes after the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "event"])


SENT = "session_id string, event string, ts timestamp, sent_at timestamp, seq int"


def delivered(events: DataFrame, late: str = "10 minutes", most: int = QUEUE) -> DataFrame:
    """What ``operators.events.delivered`` gives, of a stream of (session_id, ts, event, signal): signal is ready or failed in rows that tell of the sink, null in the others.

    A session's rows wait until the watermark has passed them and are then
    taken in order of time, so late ones within the delay change nothing. State
    is a session's names seen so far and those that wait: as many as there are names, at most.
    """
    rows = events.select(F.col("session_id").cast("string").alias("session_id"), "ts", F.unix_micros("ts").alias("us"), "event", "signal").withWatermark("ts", late)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"ready": False, "seq": 0, "seen": [], "queue": [], "wait": []}
        seen, wait = set(held["seen"]), {(s, e): t for t, s, e in held["wait"] if not s}
        signals = {(t, s) for t, s, _ in held["wait"] if s}
        for f in frames:
            for us, event, signal in zip(f.us.tolist(), f.event.tolist(), f.signal.tolist(), strict=True):
                if isinstance(signal, str):
                    signals.add((us, signal))
                elif isinstance(event, str) and event not in seen:
                    wait["", event] = min(us, wait.get(("", event), us))
        now = state.getCurrentWatermarkMs() * 1000
        # Of one time, signals come first.
        due = sorted([(t, 0, s) for t, s in signals if t < now] + [(t, 1, e) for (_, e), t in wait.items() if t < now])
        out = []
        for t, kind, what in due:
            if kind == 0:
                signals.discard((t, what))
                if what == "ready" and not held["ready"]:
                    held["ready"] = True
                    out += [(e, at, t) for at, e in held["queue"]]
                held["queue"] = []
            else:
                del wait["", what]
                seen.add(what)
                if held["ready"]:
                    out.append((what, t, t))
                elif len(held["queue"]) < most:
                    held["queue"].append((t, what))
        rest = [(t, s, "") for t, s in signals] + [(t, "", e) for (_, e), t in wait.items()]
        seq = held["seq"]
        held |= {"seen": sorted(seen), "wait": rest, "seq": seq + len(out)}
        state.update((json.dumps(held),))
        if rest:
            state.setTimeoutTimestamp(max(min(t for t, *_ in rest) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        stamps = [pd.to_datetime(pd.Series([x[k] for x in out], dtype="int64"), unit="us", utc=True) for k in (1, 2)]
        yield pd.DataFrame({"session_id": [key[0]] * len(out), "event": [x[0] for x in out], "ts": stamps[0], "sent_at": stamps[1], "seq": range(seq + 1, seq + len(out) + 1)})

    return rows.groupBy("session_id").applyInPandasWithState(step, SENT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
