"""State that expires or starts anew: pages seen lately, budgets of a month.

Each comes as a batch rule over a table and as a stream with the same outcome, which keeps one value for each key in
Spark's state store (the provider must be RocksDB's, as ``transformWithState`` asks for) and goes on from its checkpoint.
Rows of a key are taken in order of time within a batch; as with any stream, rows that come in a later batch are later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gristmill.session import ship

#: What ``transformWithState`` keeps its state in.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SEEN_DAYS = 60
#: The share of a budget at which its owner is told.
ALERT_PERCENT = 80


def unseen_lately(rows: DataFrame, key: str, time: str, days: int = SEEN_DAYS) -> DataFrame:
    """``rows`` with ``fresh``: whether its key wasn't met within so many days before.

    Every meeting counts, fresh or not, so a key that keeps coming back stays known.  Of rows at one time one is first.
    A null time is never fresh and counts for nothing.
    """
    timed = F.col(time).isNotNull()
    before = F.lag(time).over(Window.partitionBy(key, timed).orderBy(time))
    fresh = timed & (before.isNull() | (F.col(time) > before + F.expr(f"INTERVAL {days} DAYS")))
    return rows.withColumn("fresh", F.coalesce(fresh, F.lit(False)))


def within_budget(requests: DataFrame, limits: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    """``requests`` with ``used`` (of the month, this one included if granted), ``granted`` and ``alert``.

    :param limits: key, limit: requests a month, each costing one.

    Each month starts anew; once the limit is reached further requests are refused and use nothing.  ``alert`` is true
    from the request on that reaches ALERT_PERCENT.  A key without a limit is refused.
    """
    met = requests.join(limits.select(key, F.col("limit").alias("budget")), key, "left")
    turn = F.row_number().over(Window.partitionBy(key, F.trunc(time, "month")).orderBy(time, id_)).cast("long")
    return _judged(met.withColumn("turn", turn), F.col("turn"), F.coalesce("budget", F.lit(0))).drop("turn", "budget")


def _judged(rows: DataFrame, turn: Column, limit: Column) -> DataFrame:
    used = F.least(turn, limit).cast("long")
    return rows.withColumns({"used": used, "granted": turn <= limit, "alert": used * 100 >= limit * ALERT_PERCENT})


class _Seen(StatefulProcessor):
    """The time at which a key was last met; forgotten by a timer once it is too long ago to matter."""

    def __init__(self, key: str, time: str, days: int) -> None:
        self.key, self.time, self.days = key, time, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType().add("at", T.TimestampType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        met = pd.concat(rows, ignore_index=True).sort_values(self.time, kind="stable")
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        fresh, reach = [], pd.Timedelta(days=self.days)
        for at in met[self.time]:
            fresh.append(last is None or at > last + reach)
            last = at if last is None else max(last, at)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.last.update((last.to_pydatetime(),))
        self.handle.registerTimer(int((last.tz_localize("UTC") + reach).timestamp() * 1000))
        yield pd.DataFrame({self.key: [key[0]] * len(met), self.time: met[self.time].to_numpy(), "fresh": fresh})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def unseen_stream(rows: DataFrame, key: str, time: str, delay: str, days: int = SEEN_DAYS) -> DataFrame:
    """The same as a stream: key, time, fresh.  Keys not met for so long are dropped from the state by event time.

    Rows without a time are left out.
    """
    ship(rows.sparkSession)
    out = T.StructType([rows.schema[key], rows.schema[time]]).add("fresh", "boolean")
    timed = rows.select(key, time).filter(F.col(time).isNotNull()).withWatermark(time, delay)
    return timed.groupBy(key).transformWithStateInPandas(_Seen(key, time, days), out, "append", "EventTime")


class _Budget(StatefulProcessor):
    """The month of a key's last request, and how many were granted in it."""

    def __init__(self, names: tuple[str, str, str], limits: dict[str, int]) -> None:
        self.names, self.limits = names, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", T.StructType().add("month", "string").add("used", "long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        name, time, id_ = self.names
        met = pd.concat(rows, ignore_index=True).sort_values([time, id_])
        month, used = tuple(self.spent.get()) if self.spent.exists() else ("", 0)
        limit, out = self.limits.get(key[0], 0), []
        for at in met[time]:
            now = at.strftime("%Y-%m")
            if now != month:
                month, used = now, 0
            granted = used < limit
            used += granted
            out.append((used, granted, used * 100 >= limit * ALERT_PERCENT))
        self.spent.update((month, used))
        told = pd.DataFrame(out, columns=["used", "granted", "alert"])
        yield pd.concat([pd.DataFrame({name: [key[0]] * len(met), time: met[time].to_numpy(), id_: met[id_].to_numpy()}), told], axis=1)

    def close(self) -> None:
        pass


def budget_stream(requests: DataFrame, limits: dict[str, int], key: str, time: str, id_: str) -> DataFrame:
    """The same as a stream: key, time, id, used, granted, alert.

    :param limits: requests a month by key; a table of a site's own few services.
    """
    ship(requests.sparkSession)
    out = T.StructType([requests.schema[c] for c in (key, time, id_)]).add("used", "long").add("granted", "boolean").add("alert", "boolean")
    return requests.select(key, time, id_).groupBy(key).transformWithStateInPandas(_Budget((key, time, id_), limits), out, "append", "None")


def remembered(stored: DataFrame, met: DataFrame, key: str, today: Column, days: int = SEEN_DAYS) -> DataFrame:
    """A cache after a run: keys met today, and those not met for fewer than ``days`` days; each once.

    :param stored: key, seen (day); ``met``: key.
    """
    both = stored.select(key, "seen").unionByName(met.select(key, today.alias("seen")))
    last = both.groupBy(key).agg(F.max("seen").alias("seen"))
    return last.filter(F.datediff(today, F.col("seen")) < days)
