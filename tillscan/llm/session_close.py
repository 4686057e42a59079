"""Operator 13, closing sessions over rows that arrive out of order, on a stream with state.

Clicks are cut into batches by their arrival, written below ``spark.checkpoint.dir``, and fed in
order to a Structured Streaming query that is started anew for each batch on one checkpoint.
Its ``transformWithState`` keeps a map of open sessions by the day of their start, and an event-time
timer at the least of their ends. A row that bridges open sessions takes
their places in the map and moves the timer. The watermark fires the timers.

W(b) is the latest ts through batch b less ``delay``. It is known in microseconds once the batches
are cut (one number for each batch), while Spark's watermark and timers count milliseconds. So
rows of batch b before W(b-1) are dropped by their own microseconds. A timer stands at the last multiple of
``gap`` before the session's end, and what it finds is compared with W(b) exactly: a session that W(b) has
not passed gets a timer again. A session that W(b) has passed when its
rows come in closes there, without an entry. With the last batch comes one row without a
client, far in the future, which moves the watermark over what is left; one more start, on another such row, closes that. Timers that W(b) reaches fire as batch b + 1 starts, with the
watermark that the checkpoint kept, and close their sessions as of b: no row of b + 1 can reach them, and a start is
one micro-batch instead of two.

Calls from Python into the state cost far more than the work in between. So the stream is grouped by
``GROUP_CLIENTS`` clients, not by one; a group's new rows come packed (a value for each task that read them), its
sessions that start on one day are one packed value of the map, and it has one timer, at the least of their ends. Sessions are merged by
arrays. The number of groups follows the number of clients; results do not depend on it.

A client may have any share of the rows. Before the stream is dealt by client, rows are summed by
client and slot of length ``gap`` (rows of one slot always share a session) and packed within
each task that reads them. So the state's task sees at most one row for each slot of
a client, 48 a day, from each of those tasks, however many clicks there are, and a client has at most one
open session for each two slots of the delay and of a batch. The one exchange of a start is that to the state.

Defined cases: rows without click_id, client_id or ts are left out; of rows that share a
click_id the least by (ts, client_id, arrived_at) counts, so copies count once; a row
without arrived_at arrives at its ts; equal times are one moment; the table's other columns play no part, and
their names may be anything; an empty table gives no sessions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .common import CRC_SQL, crc_sql, new_folder, table

BATCHES, GAP_US, DELAY_US, LATE_EVERY = 12, 30 * 60_000_000, 120 * 3_600_000_000, 7
HOUR_US = 3_600_000_000
#: No watermark yet, and the one after the last batch.
BEFORE_ALL, AFTER_ALL = -(2**62), 2**62
#: Rows that a task sums up at a time.
SUM_ROWS = 200_000
#: Clients that share a group of the stream: a call of the processor costs as much as several sessions.
GROUP_CLIENTS = 1000
DAY_US = 24 * HOUR_US

FED = "click_id long, client_id long, us long, crc long, ts timestamp"
SESSIONS = "client_id long, first_us long, last_us long, n_clicks long, ids_crc32 long, n_merges long, close_batch long"
PACKED = "clients int, rows binary"
_NAMES = [f.split()[0] for f in SESSIONS.split(", ")]
_STORE = "spark.sql.streaming.stateStore"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A start is one commit: with change logs each would be replayed at every later start.
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "false",
    # Else each partition's store takes 4 MB of disk at once.
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    # Each start opens the stores anew; those of earlier starts would stay in the executors' memory for a minute.
    f"{_STORE}.unloadOnCommit": "true",
    # A file of sums beside each of the checkpoint's doubles the files; the checkpoint serves this one run.
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        days = F.unix_date(F.to_date(name)).cast("long")
        second = F.expr(f"cast(extract(second from `{name}`) * 1000000 as long)")
        return ((days * 24 + F.hour(name)) * 60 + F.minute(name)) * 60_000_000 + second
    return F.unix_micros(F.col(name).cast("timestamp"))


@dataclass
class Batches:
    """Batches that wait in ``staged``, and W(b) of each; batch b is published into ``source``."""

    staged: str
    source: str
    marks: list[int]
    filled: set[int]  # batches with rows
    groups: int  # of clients


def _move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(old)) and not fs.rename(path(old), path(new)):
        raise OSError(f"cannot rename {old}")


def cut_batches(clicks: DataFrame, folder: str, batches: int, delay_us: int) -> Batches:
    """Each click once, written by batch. To the driver go the hours' range and one mark a batch."""
    spark = clicks.sparkSession
    named = clicks.select(
        "click_id", "client_id", micros(clicks, "ts").alias("us"),
        F.coalesce(micros(clicks, "arrived_at"), micros(clicks, "ts")).alias("arrived"),
    ).dropna(subset=["click_id", "client_id", "us"])
    least = F.min(F.struct("us", "client_id", "arrived")).alias("x")
    once = named.dropDuplicates().groupBy("click_id").agg(least).select("click_id", "x.*")
    once.write.parquet(f"{folder}/once")
    once = spark.read.parquet(f"{folder}/once")
    hour = F.floor(F.col("arrived") / F.lit(HOUR_US))
    low, high, clients = once.agg(F.min(hour), F.max(hour), F.approx_count_distinct("client_id")).first()
    staged, source = f"{folder}/staged", f"{folder}/source"
    if low is None:
        once.limit(0).selectExpr("click_id", "client_id", "us", "us AS crc", "timestamp_micros(us) AS ts").write.parquet(source)
        return Batches(staged, source, [], set(), 1)
    moment = F.concat_ws(":", F.col("client_id").cast("string"), F.floor(F.col("us") / F.lit(HOUR_US)).cast("string"))
    late = F.when(F.crc32(moment) % LATE_EVERY == 0, 1).otherwise(0)
    batch = F.least(F.lit(batches - 1), F.floor((hour - low) * batches / F.lit(high - low + 1)) + late).cast("int")
    rows = once.select(
        "click_id", "client_id", "us", F.crc32(F.col("click_id").cast("string")).alias("crc"),
        F.timestamp_micros("us").alias("ts"), batch.alias("batch"),
    )
    rows.write.partitionBy("batch").parquet(staged)
    rows.limit(0).drop("batch").write.parquet(source)
    most = dict(spark.read.parquet(staged).groupBy("batch").agg(F.max("us")).collect())
    marks, top = [], BEFORE_ALL
    for b in range(batches):
        top = max(top, most.get(b, BEFORE_ALL))
        marks.append(top - delay_us if top > BEFORE_ALL else BEFORE_ALL)
    return Batches(staged, source, marks, set(most), 1 + clients // GROUP_CLIENTS)


def _summed(rows: pa.Table) -> pa.Table:
    keys = [c for c in ("clients", "client_id", "slot") if c in rows.column_names]
    values = [("first_us", "min"), ("last_us", "max"), ("n", "sum"), ("crc", "sum")]
    out = rows.group_by(keys, use_threads=False).aggregate(values)
    return out.rename_columns([*keys, *(v for v, _ in values)])


def sum_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each client and slot of a task, and again for each ``SUM_ROWS`` rows that stay different."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= SUM_ROWS:
            one = _summed(pa.Table.from_batches(held))
            if one.num_rows * 2 > SUM_ROWS:  # little to sum up: hand it over
                yield from one.to_batches()
                held, n = [], 0
            else:
                held, n = one.to_batches(), one.num_rows
    if held:
        yield from _summed(pa.Table.from_batches(held)).to_batches()


def pack_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed again, and the rows of a group as one value: 64-bit numbers, five a row."""
    for batch in sum_slots(batches):
        clients = batch.column("clients").to_numpy()
        order = np.argsort(clients, kind="stable")
        columns = [batch.column(c).to_numpy() for c in ("client_id", "first_us", "last_us", "n", "crc")]
        rows = np.stack(columns, axis=1).astype("<i8")[order]
        groups, begin = np.unique(clients[order], return_index=True)
        packed = [x.tobytes() for x in np.split(rows, begin[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(packed, pa.binary())], names=["clients", "rows"])


def merged(held: np.ndarray, new: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sessions (client, first, last, n, crc, merges) of open ones and new rows (without merges).

    Also whether something new is in each, and the open ones that such a session absorbs.
    """
    rows = np.concatenate([held, np.column_stack([new, np.zeros(len(new), np.int64)])])
    old = np.arange(len(rows)) < len(held)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows, old = rows[order], old[order]
    # The latest end so far of a client: places in the order of ends, which leave room for the client above them.
    ends, place = np.unique(rows[:, 2], return_inverse=True)
    client = np.cumsum(np.r_[False, rows[1:, 0] != rows[:-1, 0]])
    last = ends[np.maximum.accumulate(client * len(ends) + place) % len(ends)]
    begin = np.flatnonzero(np.r_[True, (client[1:] != client[:-1]) | (rows[1:, 1] - last[:-1] > gap)])
    size = np.diff(np.r_[begin, len(rows)])
    n_old = np.add.reduceat(old.astype(np.int64), begin)
    n, crc, merges = (np.add.reduceat(rows[:, c], begin) for c in (3, 4, 5))
    out = np.column_stack([rows[begin, 0], rows[begin, 1], last[begin + size - 1], n, crc, merges + np.maximum(n_old - 1, 0)])
    fresh = n_old < size
    return out, fresh, rows[old & np.repeat(fresh, size)]


class Sessions(StatefulProcessor):
    """Open sessions of a group of clients: day -> packed (client, first, last, n, crc, merges), and the group's timer."""

    def __init__(self, batch: int, mark: int, gap: int, last_batch: int, before: int) -> None:
        self.batch, self.mark, self.gap = batch, mark, gap
        self.last_batch, self.before = last_batch, before  # the last one with rows, and its W

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day long", "rows binary")

    def held(self) -> np.ndarray:
        found = [np.frombuffer(v[0], "<i8").reshape(-1, 6) for _, v in self.open.iterator()]
        return np.concatenate([np.empty((0, 6), np.int64), *found])

    def keep(self, sessions: np.ndarray, changed: np.ndarray) -> None:
        """Write the days on which one of the ``changed`` sessions starts or started."""
        day = sessions[:, 1] // DAY_US
        for d in np.unique(changed[:, 1] // DAY_US).tolist():
            of_day = sessions[day == d]
            if len(of_day):
                self.open.updateValue((d,), (of_day.astype("<i8").tobytes(),))
            else:
                self.open.removeKey((d,))

    def timer(self, last: int) -> int:
        """Before W > last + gap, at a multiple of the gap, so that it seldom moves."""
        return max(1, (last + self.gap) // self.gap * self.gap // 1000 - 2)

    def closed(self, sessions: np.ndarray, batch: int) -> Iterator[pd.DataFrame]:
        if len(sessions):
            yield pd.DataFrame(np.column_stack([sessions, np.full(len(sessions), batch, np.int64)]), columns=_NAMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 5) for frame in rows for x in frame["rows"]])
        sessions, fresh, absorbed = merged(self.held(), new, self.gap)
        over = fresh & (sessions[:, 2] + self.gap < self.mark)
        left = sessions[~over]
        self.keep(left, np.concatenate([absorbed, sessions[fresh & ~over]]))
        wanted = {self.timer(int(left[:, 2].min()))} if len(left) else set()
        have = set(self.handle.listTimers())
        for at_ms in have - wanted:
            self.handle.deleteTimer(at_ms)
        for at_ms in wanted - have:
            self.handle.registerTimer(at_ms)
        yield from self.closed(sessions[over], self.batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Close the group's sessions that W has passed, and wait for the next."""
        again = timerValues.getCurrentWatermarkInMs() + 1
        sessions = self.held()
        over = sessions[:, 2] + self.gap < self.before
        yield from self.closed(sessions[over], self.last_batch)
        left = sessions[~over]
        if self.mark == AFTER_ALL:  # the watermark has passed everything
            self.keep(left[:0], sessions)
            yield from self.closed(left, self.batch)
            return
        self.keep(left, sessions[over])
        if len(left):  # its timer may be one that fired up to a gap early
            self.handle.registerTimer(max(again, self.timer(int(left[:, 2].min()))))


def _feed(
    spark: SparkSession, folder: str, cut: Batches, batch: int, mark: int, last_batch: int, before: int, gap_us: int, delay_us: int
) -> None:
    """One start of the query on the one checkpoint: all that is new in the source."""
    fed = spark.readStream.schema(FED).parquet(cut.source).withWatermark("ts", f"{delay_us} microseconds")
    # Rows past all clicks are only for the watermark: a filter by ts is not moved before that.
    clicks = F.col("ts") <= F.timestamp_micros(F.lit(cut.marks[-1] + delay_us))
    group = F.pmod(F.hash("client_id"), F.lit(cut.groups)).alias("clients")
    slots = fed.filter((F.col("us") >= before) & clicks).select(
        group, "client_id", F.floor(F.col("us") / F.lit(gap_us)).alias("slot"), F.col("us").alias("first_us"),
        F.col("us").alias("last_us"), F.lit(1).cast("long").alias("n"), "crc",
    )
    sessions = slots.mapInArrow(pack_slots, PACKED).groupBy("clients").transformWithStateInPandas(
        statefulProcessor=Sessions(batch, mark, gap_us, last_batch, before), outputStructType=T.StructType.fromDDL(SESSIONS),
        outputMode="Append", timeMode="EventTime",
    )
    query = (
        sessions.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/sessions")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def close_sessions(
    clicks: DataFrame, batches: int = BATCHES, gap_us: int = GAP_US, delay_us: int = DELAY_US
) -> DataFrame:
    """The closed sessions of ``clicks`` (click_id, client_id, ts, arrived_at), after all batches."""
    spark = clicks.sparkSession
    folder = new_folder(spark, "sessions")
    cut = cut_batches(clicks, folder, batches, delay_us)
    if not cut.marks:
        return spark.createDataFrame([], SESSIONS)
    own = spark.newSession()  # the caller's settings stay as they are
    for key, value in (STATE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(key, value)
    # Timers of W(b) fire when batch b + 1 starts, so a start is one micro-batch.
    own.conf.set(NO_DATA, "false")
    # Past every timer: the last ts, the delay and a gap.
    end = cut.marks[-1] + 2 * delay_us + 2 * gap_us
    past = spark.range(1).select(
        F.lit(None).cast("long").alias("click_id"), F.lit(None).cast("long").alias("client_id"),
        F.lit(end).cast("long").alias("us"), F.lit(0).cast("long").alias("crc"), F.timestamp_micros(F.lit(end)).alias("ts"),
    )
    last, before = -1, BEFORE_ALL
    for b, mark in enumerate(cut.marks):
        _move(spark, f"{cut.staged}/batch={b}", f"{cut.source}/batch={b}")
        if b + 1 == len(cut.marks):
            past.write.parquet(f"{cut.source}/batch={batches}")
        _feed(own, folder, cut, b, mark, last, before, gap_us, delay_us)
        if b in cut.filled:  # else there was no micro-batch, and timers still wait for the last one's W
            last, before = b, mark
    past.write.parquet(f"{cut.source}/batch={batches + 1}")
    _feed(own, folder, cut, batches, AFTER_ALL, last, before, gap_us, delay_us)
    return spark.read.schema(SESSIONS).parquet(f"{folder}/sessions")


#: Batches, drops and sessions by windows over all rows; merges by counting a client's sessions after each batch.
OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
named AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(coalesce(arrived_at, ts)) AS arrived FROM clicks
  WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
),
once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY us, client_id, arrived) = 1),
texts AS (
  SELECT *, arrived // 3600000000 AS h, click_id::VARCHAR AS id_text, client_id || ':' || us // 3600000000 AS moment FROM once
),
crcs AS (
  SELECT s, {crc_sql("s")} AS crc FROM (SELECT id_text AS s FROM texts UNION SELECT moment FROM texts), crc_table
),
batched AS (
  SELECT click_id, client_id, us, i.crc AS crc,
    least(11, 12 * (h - lo) // (hi - lo + 1) + CASE WHEN m.crc % 7 = 0 THEN 1 ELSE 0 END) AS b
  FROM texts JOIN crcs i ON i.s = id_text JOIN crcs m ON m.s = moment, (SELECT min(h) AS lo, max(h) AS hi FROM texts)
),
numbers AS (SELECT range AS b FROM range(12)),
marks AS (
  SELECT b, max(max(us)) OVER (ORDER BY b) - 120 * 3600000000 AS w
  FROM numbers LEFT JOIN batched USING (b) GROUP BY b
),
kept AS (
  SELECT batched.* FROM batched LEFT JOIN marks ON marks.b = batched.b - 1 WHERE w IS NULL OR us >= w
),
-- Sessions of all rows through batch b, for each b; at the last one they are the results.
grown AS (
  SELECT n.b AS upto, k.*, coalesce(us - lag(us) OVER (PARTITION BY n.b, client_id ORDER BY us, click_id) <= 1800000000, FALSE) AS joined
  FROM numbers n JOIN kept k ON k.b <= n.b
),
placed AS (
  SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY upto, client_id ORDER BY us, click_id) AS place FROM grown
),
states AS (
  SELECT upto, client_id, place, min(us) AS first_us, max(us) AS last_us, min(b) AS b_first, count(*) AS n_clicks, sum(crc) AS ids_crc32
  FROM placed GROUP BY ALL
),
results AS (SELECT * FROM states WHERE upto = 11),
-- Before batch b the session's rows stood in so many sessions; after it in so many that held earlier rows.
steps_of AS (
  SELECT r.client_id, r.first_us, s.upto, count(*) AS n, count(*) FILTER (WHERE s.b_first < s.upto) AS with_old
  FROM results r JOIN states s ON s.client_id = r.client_id AND s.first_us BETWEEN r.first_us AND r.last_us
  GROUP BY ALL
),
merges AS (
  SELECT x.client_id, x.first_us, sum(y.n - x.with_old) AS n_merges
  FROM steps_of x JOIN steps_of y ON y.client_id = x.client_id AND y.first_us = x.first_us AND y.upto = x.upto - 1 GROUP BY ALL
)
SELECT r.client_id, r.first_us, r.last_us, r.n_clicks::BIGINT AS n_clicks, r.ids_crc32::BIGINT AS ids_crc32,
  coalesce(n_merges, 0)::BIGINT AS n_merges,
  coalesce((SELECT min(b) FROM marks WHERE r.last_us + 1800000000 < w), 12)::BIGINT AS close_batch
FROM results r LEFT JOIN merges m ON m.client_id = r.client_id AND m.first_us = r.first_us
"""


def op13_session_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts", "arrived_at")
    return close_sessions(clicks)
