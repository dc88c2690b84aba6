"""The event log, folded in batch and as a stream: session states, traces, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query, sql_query, table
from ..storage import new_path


def in_order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


#: A session's states by event: errors pause it, a purchase completes it, whatever else happens it runs.
STATE = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'CREATED' ELSE 'RUNNING' END"


def state_of(event_type: F.Column) -> F.Column:
    return F.when(event_type == "error", "FAILED").when(event_type == "purchase", "COMPLETED").when(event_type == "signup", "CREATED").otherwise("RUNNING")


@query("session_fold", f"SELECT user_id, CAST(count(*) AS BIGINT) AS events, max_by({STATE}, (ts, event_id)) AS state, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def session_fold(spark, sf):
    """The last state of each session: an aggregation with partial results, no sort of the log."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max_by(state_of(F.col("event_type")), F.struct("ts", "event_id")).alias("state"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("event_fold", f"SELECT event_id, user_id, {STATE} AS state, lag({STATE}) OVER w AS previous, CAST(row_number() OVER w AS BIGINT) AS sequence, CAST(count(*) FILTER (event_type = 'error') OVER w AS BIGINT) AS errors_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_fold(spark, sf):
    """The state after each event, the one before it, and its place in the session."""
    state = state_of(F.col("event_type"))
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", state.alias("state"), F.lag(state).over(in_order()).alias("previous"), F.row_number().over(in_order()).cast("bigint").alias("sequence"), F.count_if(F.col("event_type") == "error").over(in_order()).alias("errors_so_far"))


@query("events_since", "SELECT event_id, user_id, sequence FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence FROM events) x WHERE sequence > 5")
def events_since(spark, sf, sequence: int = 5):
    e = table(spark, sf, "events").withColumn("sequence", F.row_number().over(in_order()).cast("bigint"))
    return e.where(F.col("sequence") > sequence).select("event_id", "user_id", "sequence")


sql_query("trace_summary", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases, round(sum(value), 2) AS value FROM events GROUP BY user_id")


@query("rate_limit_window", "SELECT user_id, date_trunc('hour', ts) AS window_start, CAST(count(*) AS BIGINT) AS requests, greatest(CAST(count(*) AS BIGINT) - 1, 0) AS rejected FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) > 1")
def rate_limit_window(spark, sf, limit: int = 1, length: str = "1 hour"):
    """Requests over a limit a user and window."""
    e = table(spark, sf, "events").groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return e.where(F.col("requests") > limit).select("user_id", F.col("w.start").alias("window_start"), "requests", (F.col("requests") - limit).alias("rejected"))


def allowed_requests(log: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """user_id, requests and allowed of a log that is all there: a token bucket a user, filled by the time between its events. For a log that goes on, see token_buckets."""
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = log.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", second.alias("at")))).alias("r"))
    start = F.struct(F.lit(float(capacity)).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, x):
        now = F.least(F.lit(float(capacity)), acc["tokens"] + F.coalesce((x["at"] - acc["last"]) * per_second, F.lit(0.0)))
        return F.struct(F.when(now >= 1, now - 1).otherwise(now).alias("tokens"), x["at"].alias("last"), (acc["n"] + F.when(now >= 1, 1).otherwise(0)).alias("n"))

    return rows.select("user_id", F.size("r").cast("bigint").alias("requests"), F.aggregate("r", start, step)["n"].alias("allowed"))


@query("rate_limit_tokens", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6 AS sec FROM events),
 r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 2.0::DOUBLE AS tokens, NULL::DOUBLE AS last, CAST(0 AS BIGINT) AS n FROM e
  UNION ALL SELECT user_id, i, CASE WHEN t >= 1 THEN t - 1 ELSE t END, sec, n + CASE WHEN t >= 1 THEN 1 ELSE 0 END FROM (SELECT r.user_id, e.i, e.sec, r.n, least(2.0::DOUBLE, r.tokens + coalesce((e.sec - r.last) * (1.0::DOUBLE / 172800), 0)) AS t FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) x)
 SELECT user_id, max(i) AS requests, max(n) AS allowed FROM r GROUP BY user_id""")
def rate_limit_tokens(spark, sf):
    """Two requests at once, and one more each two days."""
    return allowed_requests(table(spark, sf, "events"), 2.0, 1.0 / 172800)


@query("session_expiry", """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
 SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 2 DAY AS expires, CAST(count(*) AS BIGINT) AS events, max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) AS expired FROM s GROUP BY user_id, k""")
def session_expiry(spark, sf, gap: str = "2 days"):
    """Sessions that end by a gap, and which of them have expired at the end of the log."""
    log = table(spark, sf, "events")
    s = log.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    end = log.agg(F.max("ts").alias("end"))
    return s.crossJoin(F.broadcast(end)).select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("expires"), "events", (F.col("w.end") <= F.col("end")).alias("expired"))


def token_buckets(stream: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """event_id, user_id and allowed of a stream of events: a token bucket a user, kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for at in rows["ts"].astype("int64") / 1e9:
            tokens = min(capacity, tokens + (0.0 if last is None else max(0.0, at - last) * per_second))
            last = at if last is None else max(last, at)
            allowed.append(tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
        state.update((tokens, last))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    return stream.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The event log as a stream; ts as a timestamp, which watermarks need."""
    log = table(spark, sf_dir, "events")
    # a stream reads a folder: that of the parts, or for a table of one file the folder it is in
    single = all(f.endswith("/events.parquet") for f in log.inputFiles())
    folder, names = (sf_dir, "events.parquet") if single else (f"{sf_dir}/events.parquet", "*.parquet")
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type, with a watermark for late ones."""
    day = F.window("ts", "1 day").alias("w")
    return stream.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, into files, and gives their table: in complete mode the last batch, else all.

    A batch that is run again after a failure replaces its own files.
    """
    spark = df.sparkSession
    path = new_path(spark, "stream")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        last.append(number)

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/rows/batch={last[-1]}" if mode == "complete" else f"{path}/rows")


@query("stream_events", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_events(spark, sf):
    """Replays the log through Structured Streaming; in complete mode it equals the batch result."""
    out = run_to_table(daily_counts(replay(spark, sf)), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("v", 2).alias("total"))
