"""Windows over events, and state that moves on in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import membership
from ..streaming import windows
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def q30_tumbling(a: Archive) -> DataFrame:
    return windows.tumbling(a.table("events"), "1 hour", ["event_type"]).select("start", "event_type", "n", "users")


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1""")
def q31_sliding(a: Archive) -> DataFrame:
    return windows.sliding(a.table("events"), "1 hour", "30 minutes", []).select("start", "n")


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS stop, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def q32_sessions(a: Archive) -> DataFrame:
    return windows.sessions(a.table("events"), "10 minutes", ["user_id"]).select("user_id", "start", "stop", "n")


@query("SELECT user_id, count(*) AS n, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def q33_last_state(a: Archive) -> DataFrame:
    return windows.last_state(a.table("events"))


@query("SELECT id, CASE WHEN spent <= 20000 THEN 'PROCESSED' ELSE 'DEFERRED' END AS state, CAST(spent AS BIGINT) AS spent FROM (SELECT id, sum(size) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS spent FROM alloc WHERE id > 5 AND id % 3 < 2)")
def q61_task_batch(a: Archive) -> DataFrame:
    state = F.when(F.col("id") % 3 == 0, "PENDING").when(F.col("id") % 3 == 1, "CONTINUING").otherwise("PROCESSED")
    return membership.batch(a.alloc.select("id", state.alias("state"), F.col("size").alias("cost")), 5, 20000).select("id", "state", "spent")
