"""Lines followed as they come: keyed state a market, alerts on sharp and steady moves, and cards compared scan by scan."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import refresh as R
from ..sources import commits
from ..sources.tables import written

#: Fixed values, in millionths of a probability: a sharp move, a step that counts as steady, a move with a direction, the growth that alerts again.
SHARP, STEADY, DIRECTED, AGAIN = 50_000, 5_000, 20_000, 50_000


def line_alerts(stream: DataFrame, market: str, time: str, prob: str, late: str = "1 hour", again: int = AGAIN, idle_hours: float | None = None) -> DataFrame:
    """Alerts (market, time, kind, direction, movement, opening, current, n_snapshots) of markets' lines, in append mode.

    A snapshot is the mean of a market's quotes of one time. It is judged, once, when the watermark
    has passed it, in the order of time, so the alerts do not depend on how quotes are dealt over
    files and batches as long as none comes later than ``late``. ``sharp``: the line is more than five
    points from its opening. ``steam``: two steps or more, all by more than half a point the same way.
    A kind and direction alerts first when it occurs and again when its movement has grown by
    ``again``. The state of a market is its opening, its last price, whether all steps rose or fell,
    the last alerts and the quotes' sums of the times that are still open; with ``idle_hours`` it is
    forgotten that long after its last snapshot. Prices are compared in millionths, so the order in
    which quotes are summed does not matter.
    """

    def judge(s: dict, t: int, p: int) -> Iterator[tuple]:
        if not s["n"]:
            s |= {"n": 1, "open": p, "last": p, "up": True, "down": True, "t": t}
            return
        step, move = p - s["last"], p - s["open"]
        s |= {"n": s["n"] + 1, "last": p, "up": s["up"] and step > STEADY, "down": s["down"] and step < -STEADY, "t": t}
        way = "toward_a" if move > DIRECTED else "toward_b" if move < -DIRECTED else "stable"
        for kind, is_so in (("sharp", abs(move) > SHARP), ("steam", s["n"] >= 3 and (s["up"] or s["down"]))):
            key = f"{kind} {way}"
            if is_so and abs(move) >= s["alerts"].get(key, -again) + again:
                s["alerts"][key] = abs(move)
                yield t, kind, way, move / 1e6, s["open"] / 1e6, p / 1e6, s["n"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"n": 0, "alerts": {}, "pending": {}, "t": None}
        pending = s["pending"]
        if not state.hasTimedOut:
            for f in frames:  # a market has a few rows in a batch: plain numbers are quicker than frames of them
                for t, p in zip(f["t"].tolist(), f["p"].tolist()):
                    if None not in (t, p) and t == t and p == p:  # times beside an unknown one come as floats
                        at_ = str(int(t))
                        total, count = pending.get(at_, (0.0, 0))
                        pending[at_] = (total + p, count + 1)
        now, out = state.getCurrentWatermarkMs(), []
        for t in sorted(map(int, pending)):
            if t < now:
                total, count = pending.pop(str(t))
                out += judge(s, t, int(total / count * 1e6 + 0.5))
        end = None if idle_hours is None or s["t"] is None else s["t"] + int(idle_hours * 3.6e6)
        if not pending and end is not None and end < now:
            state.remove()
        else:
            state.update((json.dumps(s),))
            due = min(map(int, pending)) if pending else end
            if due is not None:
                state.setTimeoutTimestamp(max(due, now + 1))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["k", "t", "kind", "direction", "movement", "opening", "current", "n_snapshots"])

    at = F.col(time).cast("timestamp")
    src = stream.select(F.col(market).alias("k"), at.alias("at"), F.unix_millis(at).alias("t"), F.col(prob).cast("double").alias("p")).withWatermark("at", late)
    schema = f"k {src.schema['k'].dataType.simpleString()}, t long, kind string, direction string, movement double, opening double, current double, n_snapshots long"
    found = src.groupBy("k").applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("k").alias(market), F.timestamp_millis("t").alias(time), "kind", "direction", "movement", "opening", "current", "n_snapshots")


# cards ----------------------------------------------------------------------------------------
CHANGE = "old_key long, new_key long, change string"
NOTICE = "event long, stayed long, left long, replacement long, days_to_event int"


def save_scan(scan: DataFrame, feed: str, number: int, complete: bool = True) -> bool:
    """One scan of all cards, visible as a whole or not at all; False if that number stands already."""
    return commits.commit_frames({"card": scan}, feed, number, {"complete": complete})


def monitor_cards(spark: SparkSession, feed: str, root: str, checkpoint: str):
    """A started query that compares each new scan of ``feed`` with the state before it.

    For each scan one commit under ``root`` holds the changes, the short-notice replacements and the
    card as it then stands. The first scan is what later ones are compared with. An incomplete scan
    removes nothing: what it does not show is carried on, unless it was moved or replaced. A scan
    that is committed is passed over, so replays, restarts and second monitors change nothing; one
    that is older than the last committed scan is passed over too.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for e in sorted(batch.collect(), key=lambda e: e["batch"]):  # one small row a scan
            last = commits.latest(spark, root)
            if last is not None and last["batch"] >= e["batch"]:
                continue
            complete = json.loads(e["note"])["complete"]
            scan = commits.read_frame(spark, feed, e.asDict(), "card")
            if last is None:
                old, complete = scan, True
            else:
                old = commits.read_frame(spark, root, last, "card", scan.schema)
            changes = written(R.card_changes(old, scan, complete), "card-changes")  # the card reads it too
            notice = R.short_notice(old, scan)
            card = scan
            if not complete:
                superseded = scan.select("key").unionByName(changes.where("old_key is not null").select(F.col("old_key").alias("key")))
                card = scan.unionByName(old.join(superseded, "key", "left_anti").select(*scan.columns))
            commits.commit_frames({"changes": changes, "notice": notice, "card": card}, root, e["batch"], {"complete": complete})

    commits_seen = spark.readStream.schema(commits.ENTRY).json(f"{feed}/{commits.LOG}")
    return commits_seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
