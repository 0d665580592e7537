"""Replay of a journal as a stream: bounded state a channel, hourly decisions for every channel, late rows set apart.

A tick is a row without an event that closes an hour for one channel: everything up to it has been seen. Each
tick gives a decision, for silent channels too. An event at or before its channel's last tick is late; it
changes nothing and comes out as a row of kind 'late', so that nothing is lost silently. The same machine runs
over a bounded table, so stream and batch agree by construction.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators.alerts import TERMS, THRESHOLD
from tidelog.operators.ordered import fold

VERSION = 2
DAY, WEEK = timedelta(hours=24), timedelta(hours=168)

DECISION = "channel_id string, at timestamp_ntz, kind string, admission_status string, reasons string, rule_score double, warning_status string"
STATE = "payload string"

#: What an input row needs: effect is null for a tick, blocking marks a measurement that quality rules out for a day.
INPUT = ["channel_id", "ts", "row_id", "state", "effect", "technical", "blocking"]


class Channel:
    """The state of one channel: times inside their horizons, the registered state, the last warning and tick."""

    def __init__(self, payload: str | None = None):
        s = json.loads(payload) if payload else {"version": VERSION}
        if s["version"] != VERSION:
            raise ValueError(f"state of version {s['version']}, code of version {VERSION}")
        read = lambda x: None if x is None else datetime.fromisoformat(x)
        self.faults, self.technical, self.completed, self.blocked = ([read(x) for x in s.get(k, [])] for k in ("faults", "technical", "completed", "blocked"))
        self.normal, self.opened, self.warned, self.tick, self.seen = (read(s.get(k)) for k in ("normal", "opened", "warned", "tick", "seen"))
        self.uncertain, self.spoilt, self.confident = s.get("uncertain", False), s.get("spoilt", False), s.get("confident", False)

    def dump(self) -> str:
        text = lambda x: None if x is None else x.isoformat()
        lists = {k: [text(x) for x in getattr(self, k)] for k in ("faults", "technical", "completed", "blocked")}
        return json.dumps({"version": VERSION, **lists, **{k: text(getattr(self, k)) for k in ("normal", "opened", "warned", "tick", "seen")}, "uncertain": self.uncertain, "spoilt": self.spoilt, "confident": self.confident}, sort_keys=True)

    def observe(self, at: datetime, rows: list[dict[str, Any]]) -> None:
        """One whole instant; its rows have no order."""
        self.seen = at
        effects = {r["effect"] for r in rows}
        conflict = len({r["state"] for r in rows}) > 1
        self.faults += [at for r in rows if r["effect"] == "fault"]
        self.technical += [at for r in rows if r["technical"]]
        self.blocked += [at for r in rows if r["blocking"]]
        if conflict:
            self.normal, self.uncertain, self.spoilt = None, True, True
        if "fault" in effects:
            if self.opened is None:
                self.confident = not conflict and not self.uncertain and self.normal is not None and timedelta(0) < at - self.normal <= WEEK
                self.opened, self.spoilt = at, conflict
            self.normal = None
        elif conflict:
            pass
        elif effects == {"normal"}:
            if self.opened is not None and self.confident and not self.spoilt:
                self.completed.append(at)
            self.normal, self.opened, self.uncertain = at, None, False
        elif "uncertain" in effects:
            self.normal, self.uncertain, self.spoilt = None, True, True

    def decide(self, at: datetime) -> tuple[str, str, float | None, str]:
        self.faults, self.completed = ([t for t in x if t > at - WEEK] for x in (self.faults, self.completed))
        self.technical, self.blocked = ([t for t in x if t > at - DAY] for x in (self.technical, self.blocked))
        reasons = []
        if self.seen is None:
            reasons.append("no_observations_in_current_archive_segment")
        else:
            if self.opened is not None:
                reasons.append("registered_episode_active_at_t")
            if self.uncertain:
                reasons.append("uncertain_past_registered_state")
            if self.normal is None or at - self.normal > WEEK:
                reasons.append("no_recent_explicit_normal_at_t")
            if self.blocked:
                reasons.append("qa_unusable_measurement_24h")
        self.tick = at
        status = "eligible" if not reasons else "excluded" if self.opened is not None else "unknown"
        if reasons:
            return status, ",".join(sorted(reasons)), None, "not_scored"
        counts = {"registered_fault_text_count_24h": sum(t > at - DAY for t in self.faults), "registered_fault_text_count_168h": len(self.faults), "completed_episode_count_168h": len(self.completed), "technical_message_count_24h": len(self.technical)}
        score = sum(w * counts[k] for k, w in TERMS.items())
        if score < THRESHOLD:
            return status, "", score, "below_threshold"
        if self.warned is not None and at < self.warned + DAY:
            return status, "", score, "suppressed_cooldown"
        self.warned = at
        return status, "", score, "emitted_research_warning"

    def run(self, channel: str, rows: Iterable[dict[str, Any]]) -> list[tuple]:
        """rows in order of time, ticks after the events of their instant."""
        out, group = [], []
        for r in [*rows, None]:
            if group and (r is None or r["effect"] is None or r["ts"] != group[0]["ts"]):
                self.observe(group[0]["ts"], group)
                group = []
            if r is None:
                continue
            if r["effect"] is None:
                if self.tick is None or r["ts"] > self.tick:
                    out.append((channel, r["ts"], "decision", *self.decide(r["ts"])))
            elif self.tick is not None and r["ts"] <= self.tick:
                out.append((channel, r["ts"], "late", None, str(r["row_id"]), None, None))
            else:
                group.append(r)
        return out


def with_ticks(events: DataFrame, start: str, end: str, hours: int) -> DataFrame:
    """Events and a tick for every channel and hour of [start, end]; events without `blocking` block nothing."""
    if "blocking" not in events.columns:
        events = events.withColumn("blocking", F.lit(False))
    grid = F.explode(F.expr(f"sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{end}', INTERVAL '{hours}' HOUR)"))
    ticks = events.select("channel_id").distinct().select("channel_id", grid.alias("ts"), F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("effect"), F.lit(False).alias("technical"), F.lit(False).alias("blocking"))
    return events.select(*INPUT).unionByName(ticks)


class _Batch:
    def __init__(self, key: tuple):
        self.channel, self.state, self.held = key[0], Channel(), []

    def step(self, r: dict) -> Iterable[tuple]:
        out = []
        if self.held and (r["ts"] != self.held[0]["ts"] or r["effect"] is None):
            out, self.held = self.state.run(self.channel, self.held), []
        if r["effect"] is None:
            return out + self.state.run(self.channel, [r])
        self.held.append(r)
        return out

    def finish(self) -> Iterable[tuple]:
        return self.state.run(self.channel, self.held) if self.held else []


def replay(rows: DataFrame) -> DataFrame:
    """Decisions of a bounded table of events and ticks."""
    marked = rows.withColumn("is_tick", F.col("effect").isNull())
    return fold(marked, ["channel_id"], ["ts", "is_tick", "row_id"], _Batch, DECISION)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    channel = Channel(state.get[0] if state.exists else None)
    rows = pd.concat(list(frames))
    rows["is_tick"] = rows["effect"].isna()
    rows = rows.sort_values(["ts", "is_tick", "row_id"], kind="stable")
    events = [{"ts": t.to_pydatetime(), "row_id": None if pd.isna(i) else int(i), "state": s, "effect": None if pd.isna(e) else e, "technical": bool(x), "blocking": bool(b)} for t, i, s, e, x, b in zip(rows["ts"], rows["row_id"], rows["state"], rows["effect"], rows["technical"], rows["blocking"], strict=True)]
    out = channel.run(key[0], events)
    state.update((channel.dump(),))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])


def decisions(stream: DataFrame) -> DataFrame:
    """The same over a stream. An instant's rows must arrive in one micro-batch, which closed groups do."""
    return stream.select(*INPUT).groupBy("channel_id").applyInPandasWithState(_update, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(out: DataFrame, path: str, checkpoint: str) -> list[tuple[int, int, float]]:
    """Everything that is there, into parts named by epoch: an epoch that is repeated is written once.

    Returns (epoch, rows read, seconds) of every micro-batch.
    """
    from tidelog.sources.sinks import append_once

    def write(df: DataFrame, epoch: int) -> None:
        append_once(df, path, f"{epoch:08d}")

    stream = out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return [(p.batchId, p.numInputRows, p.durationMs["triggerExecution"] / 1000) for p in stream.recentProgress]


def latency(batches: list[tuple[int, int, float]]) -> dict[str, float]:
    """Micro-batches, rows, and the seconds of a micro-batch: median, 95th and 99th percentile, most."""
    seconds = sorted(s for _, n, s in batches if n)
    at = lambda q: seconds[min(len(seconds) - 1, int(q * len(seconds)))] if seconds else 0.0
    return {"batches": len(seconds), "rows": sum(n for _, n, _ in batches), "p50": at(0.5), "p95": at(0.95), "p99": at(0.99), "most": at(1.0)}


def sliding_counts(stream: DataFrame, by: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts of rows (by, ts) in windows [start, start + width) that begin every `slide`; a window is given once, when the watermark has passed it."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(*by, F.window("at", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").cast("timestamp_ntz").alias("start_at"), "n")


def sessions(stream: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of rows (by, ts): runs without a silence of `gap`; end_at is the last row's time and the gap."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy(*by, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*by, F.col("w.start").cast("timestamp_ntz").alias("start_at"), F.col("w.end").cast("timestamp_ntz").alias("end_at"), "n")
