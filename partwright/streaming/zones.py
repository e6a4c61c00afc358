"""Load of plant zones in short windows, in batch and as a stream.

Readings are ``zone_id, ts, reading_id, status, load``. Each window keeps the last valid load, clamped;
windows in which a zone was only offline hold the value of the window before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from partwright.operators import sequences as seq
from partwright.streaming import runs

# ---- fixed values ---------------------------------------------------------------------------
WINDOW_MS = 3500
LOAD_MIN, LOAD_MAX = 40.0, 99.0
OFFLINE = "offline"
# ---------------------------------------------------------------------------------------------

SLOT_MS = 24 * 3600 * 1000
#: The stream keeps its state per zone and span of this length: what a task holds is bounded by the windows of a span.
SPAN_MS = 6 * 3600 * 1000


def clamp(load: Column) -> Column:
    """Null stays null: ``least`` and ``greatest`` would skip it."""
    return F.when(load.isNotNull(), F.least(F.lit(LOAD_MAX), F.greatest(F.lit(LOAD_MIN), load)))


def clamped(readings: DataFrame) -> DataFrame:
    """Clamped load of each reading; offline readings stay as they are."""
    return readings.withColumn("load", F.when(F.col("status") == OFFLINE, F.col("load")).otherwise(clamp(F.col("load"))))


def partial_loads(readings: DataFrame) -> DataFrame:
    """Last reading and last valid reading per zone and window, with the order they are last by: parts of a window
    from different batches can be put together again."""
    order = F.struct("ts", "reading_id")
    valid = F.when(F.col("status") != OFFLINE, order)
    return readings.groupBy("zone_id", F.window("ts", f"{WINDOW_MS} milliseconds").alias("w")).agg(
        F.max(F.struct(order.alias("at"), "status")).alias("last"), F.max(F.when(valid.isNotNull(), F.struct(order.alias("at"), "load"))).alias("valid")
    ).select("zone_id", F.unix_millis("w.start").alias("window_ms"), "last", "valid")


def merged_loads(parts: DataFrame) -> DataFrame:
    """Last status and last valid load per zone and window."""
    whole = parts.groupBy("zone_id", "window_ms").agg(F.max("last").alias("last"), F.max("valid").alias("valid"))
    return whole.select("zone_id", "window_ms", F.col("last.status").alias("status"), clamp(F.col("valid.load")).alias("own_load"))


def window_loads(readings: DataFrame) -> DataFrame:
    """Last status and last valid load per zone and window; partial results combine before the shuffle."""
    return merged_loads(partial_loads(readings))


class HeldLoads(StatefulProcessor):
    """Windows of one zone and span as readings arrive: gives every window whose status or load is new or has changed.

    A window keeps its last reading and its last valid reading; its load is the last valid one up to it within the span,
    null before the first. A late reading is entered where it belongs, and the windows after it that hold its load are
    given again. The windows of a span are read and written in one call each: they are some thousands at most, however many
    readings there are. With ``late`` set, windows the watermark has passed are closed by timers: they leave the state, but
    for the load they hand on, and that goes with the span.
    """

    COLUMNS = "zone_id long, window_ms long, status string, load double"

    def __init__(self, late: bool):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getListState("windows", "window_ms long, at long, at_id long, status string, own_at long, own_id long, own_load double")
        #: The load that closed windows hand on.
        self.closed = handle.getValueState("closed", "load double")

    def _kept(self) -> tuple[dict[int, tuple], float | None]:
        windows = {w[0]: tuple(w[1:]) for w in self.windows.get()} if self.windows.exists() else {}
        return windows, self.closed.get()[0] if self.late and self.closed.exists() else None

    def _keep(self, windows: dict[int, tuple]) -> None:
        if windows:
            self.windows.put([(at, *windows[at]) for at in sorted(windows)])
            if self.late:
                self.handle.registerTimer(min(windows) + WINDOW_MS)
        else:
            self.windows.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        met: dict[int, list] = {}
        for frame in rows:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            for at, at_id, status, load in zip(micros.tolist(), frame["reading_id"].tolist(), frame["status"].tolist(), frame["load"].tolist()):
                start = at // (WINDOW_MS * 1000) * WINDOW_MS
                own = met.setdefault(start, [None, None])
                if own[0] is None or (at, at_id) > own[0][:2]:
                    own[0] = (at, at_id, status)
                if status != OFFLINE and (own[1] is None or (at, at_id) > own[1][:2]):
                    own[1] = (at, at_id, None if pd.isna(load) else min(LOAD_MAX, max(LOAD_MIN, load)))
        windows, held = self._kept()
        out, was, load = [], held, held
        for at in sorted({*windows, *met}):
            old = windows.get(at)
            last, valid = met.get(at, (None, None))
            now = list(old or (None,) * 6)
            if last is not None and (old is None or last[:2] > old[:2]):
                now[:3] = last
            if valid is not None and (old is None or old[3] is None or valid[:2] > old[3:5]):
                now[3:] = valid
            windows[at] = tuple(now)
            load = load if now[5] is None else now[5]
            if old is not None:
                was = was if old[5] is None else old[5]
            if old is None or (old[2], was) != (now[2], load):
                out.append((key[0], at, now[2], load))
        self._keep(windows)
        yield pd.DataFrame(out, columns=["zone_id", "window_ms", "status", "load"]).astype({"load": "Float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        windows, held = self._kept()
        past = sorted(at for at in windows if at + WINDOW_MS <= upto)
        for at in past:
            own = windows.pop(at)[5]
            held = held if own is None else own
        if past:
            self._keep(windows)
        end = (key[1] + 1) * SPAN_MS + WINDOW_MS
        if end <= upto and not windows:
            self.closed.clear()
        elif held is not None:
            self.closed.update((held,))
            if not windows:
                self.handle.registerTimer(end)
        yield pd.DataFrame({"zone_id": [], "window_ms": [], "status": [], "load": []}).astype({"zone_id": "int64", "window_ms": "int64", "status": "str", "load": "Float64"})

    def close(self) -> None:
        pass


def changed_loads(readings: DataFrame, late: str | None = None) -> DataFrame:
    """A stream of ``zone_id, window_ms, status, load``: windows as they begin and whenever their status or load changes,
    the load held from the windows before included as far as they lie in the same span; ``latest_loads`` carries it on from
    earlier spans. State is kept per zone and span. Without ``late`` no reading is too late and all windows stay in the
    state (on disk); with it (an interval) windows close behind the watermark."""
    runs.with_state_store(readings.sparkSession)
    timed = readings if late is None else readings.withWatermark("ts", late)
    micros, window = F.unix_micros("ts"), F.lit(WINDOW_MS * 1000)
    start = ((micros - F.pmod(micros, window)) / 1000).cast("long")
    keyed = timed.where("ts is not null").select(F.col("zone_id").cast("long").alias("zone_id"), F.floor(start / SPAN_MS).alias("span"), "ts", F.col("reading_id").cast("long").alias("reading_id"), "status", F.col("load").cast("double").alias("load"))
    return keyed.groupBy("zone_id", "span").transformWithStateInPandas(HeldLoads(late is not None), HeldLoads.COLUMNS, "Update", "None" if late is None else "EventTime")


def load_stream(readings: DataFrame, base: str | None = None, late: str | None = None) -> DataFrame:
    """Loads of every window as far as the stream has come, readable after every batch; ``base`` is the folder of results
    and state, to go on from an earlier run. A window given several times counts as given last."""
    spark = readings.sparkSession
    read = runs.run_available(changed_loads(readings, late), base or runs.new_folder(spark, "zones"), lambda batch: {"loads": batch}, "update")
    return latest_loads(read)


def latest_loads(read) -> DataFrame:
    """The windows as given last; where a span begins without a valid reading, the load comes from the spans before."""
    given = read("loads", T.StructType.fromDDL(HeldLoads.COLUMNS))
    newest = given.groupBy("zone_id", "window_ms").agg(F.max_by(F.struct("status", "load"), "batch").alias("l"))
    return hold_last(newest.select("zone_id", "window_ms", "l.status", F.col("l.load").alias("own_load")))


def hold_last(loads: DataFrame) -> DataFrame:
    """Fill windows without a valid load from the last one before; zones are cut into days."""
    slot = F.floor(F.col("window_ms") / SLOT_MS)
    return seq.carry_forward(loads, ["zone_id"], "window_ms", slot, "own_load", "load").drop("own_load")
