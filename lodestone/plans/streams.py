"""Stream queries, held against the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query, r6, s6, table
from lodestone.streaming import events as S

_DAY = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, " + s6("sum(value)") + " AS total FROM events GROUP BY ALL"


@query("z06_tumbling_windows", _DAY)
def z06(spark, sf_dir):
    return S.tumbling(table(spark, sf_dir, "events")).withColumn("total", r6(F.col("total")))


@query("z01_stream_replay", _DAY)
def z01(spark, sf_dir):
    """The events replayed as a stream until used up."""
    folder = S.stored(spark)
    table(spark, sf_dir, "events").write.parquet(folder)
    return S.replay(spark, folder, table(spark, sf_dir, "events").schema, S.tumbling).withColumn("total", r6(F.col("total")))


@query("z06_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"))


@query("z02_pending_requests", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') ORDER BY event_id LIMIT 50")
def z02(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return S.pending(e.select("event_id"), e.where("event_type = 'view'"), "event_id", 50)


@query("z03_idempotent_append", "SELECT DISTINCT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def z03(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    batch = e.where("event_id % 3 = 0")
    return S.append_new(e.where("event_id % 2 = 0"), batch.unionAll(batch), "event_id")


@query("w11_prior_decay", "SELECT event_id, " + s6("3.0 / (1 + n)") + " AS weight FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)")
def w11(spark, sf_dir):
    """The prior's weight after each user's earlier observations."""
    from pyspark.sql.window import Window

    from lodestone.operators.design import decayed

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("event_id", n.alias("n")).select("event_id", r6(decayed(3.0, F.col("n"))).alias("weight"))
