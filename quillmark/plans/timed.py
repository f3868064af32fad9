"""Time-based queries over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.registry import query, table
from quillmark.streaming import limiters

ORDERED = "SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events"


@query(f"""WITH RECURSIVE o AS ({ORDERED}), w AS (SELECT event_id, event_type, r, ts AS started, 1::BIGINT AS attempts FROM o WHERE r = 1
 UNION ALL SELECT o.event_id, o.event_type, o.r, CASE WHEN o.ts - w.started > INTERVAL 1 HOUR THEN o.ts ELSE w.started END, CASE WHEN o.ts - w.started > INTERVAL 1 HOUR THEN 1 ELSE attempts + 1 END FROM w JOIN o ON o.event_type = w.event_type AND o.r = w.r + 1)
SELECT event_id, event_type, attempts, attempts <= 4 AS admitted FROM w""")
def fixed_window_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return limiters.fixed_window_table(events, "event_type", "ts", "event_id", 4).drop("ts")


@query(f"""WITH RECURSIVE o AS ({ORDERED}), w AS (SELECT event_id, event_type, r, [ts] AS stamps, true AS admitted FROM o WHERE r = 1
 UNION ALL SELECT event_id, event_type, r, CASE WHEN len(kept) < 4 THEN list_append(kept, ts) ELSE kept END, len(kept) < 4 FROM (SELECT o.event_id, o.event_type, o.r, o.ts, list_filter(w.stamps, lambda s: o.ts - s < INTERVAL 1 HOUR) AS kept FROM w JOIN o ON o.event_type = w.event_type AND o.r = w.r + 1))
SELECT event_id, event_type, admitted FROM w""")
def sliding_log_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return limiters.sliding_log_table(events, "event_type", "ts", "event_id", 4, limiters.HOUR).drop("ts")


@query("""WITH b AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 720 MINUTE, true) AS begins FROM events),
s AS (SELECT user_id, ts, CAST(sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM b), f AS (SELECT *, min(ts) OVER (PARTITION BY user_id, session) AS first FROM s)
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n_events, max(ts) - min(ts) >= INTERVAL 24 HOUR AS expired, count(*) FILTER (ts - first < INTERVAL 24 HOUR) AS n_live FROM f GROUP BY user_id, session""")
def session_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = limiters.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 720, 24)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiters.windowed_counts(table(spark, sf_dir, "events"), "event_type", "ts").withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("""SELECT user_id, ts, event_id, CASE WHEN event_id % 13 = 0 THEN 'revoked' WHEN event_id % 17 = 0 THEN 'changed' WHEN ts >= started + INTERVAL 24 HOUR THEN 'expired' WHEN ts >= least(started + INTERVAL 24 HOUR, seen + INTERVAL 720 MINUTE) THEN 'idle' END AS refused,
 coalesce(event_id % 13 <> 0 AND event_id % 17 <> 0 AND ts < started + INTERVAL 24 HOUR AND ts < seen + INTERVAL 720 MINUTE AND ts - seen > INTERVAL 5 MINUTE, false) AS touch FROM (SELECT *, date_trunc('day', ts) AS started, date_trunc('hour', ts) - (event_id % 14) * INTERVAL 1 HOUR AS seen FROM events)""")
def session_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a request with a session that began at its day's start and was last seen some hours before."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    at = F.col("event_id")
    started = F.date_trunc("day", "t")
    seen = F.timestamp_micros(F.unix_micros(F.date_trunc("hour", "t")) - at % 14 * 3_600_000_000)
    absolute = started + F.expr("INTERVAL 24 HOURS")
    session = rows.select("user_id", "ts", "event_id", "t", F.when(at % 13 == 0, F.col("t")).alias("revoked_at"), absolute.alias("expires_at"), F.least(absolute, seen + F.expr("INTERVAL 720 MINUTES")).alias("idle_expires_at"), seen.alias("last_seen_at"), F.lit(1).alias("auth_version"), F.when(at % 17 == 0, 2).otherwise(1).alias("user_version"))
    return limiters.checked_sessions(session, F.col("t"), 720).select("user_id", "ts", "event_id", "refused", "touch")


ATTEMPTS = "SELECT event_id, user_id % 20 AS k, ts, event_type = 'purchase' AS success FROM events"


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS r FROM ({ATTEMPTS})), z AS (SELECT DISTINCT k FROM o),
w AS (SELECT k, 0::BIGINT AS r, 0::BIGINT AS event_id, CAST([] AS TIMESTAMP[]) AS stamps, true AS admitted FROM z
 UNION ALL SELECT k, r, event_id, CASE WHEN len(kept) >= 2 THEN kept WHEN success THEN CAST([] AS TIMESTAMP[]) ELSE list_append(kept, ts) END, len(kept) < 2 FROM (SELECT o.k, o.r, o.event_id, o.ts, o.success, list_filter(w.stamps, lambda s: o.ts - s < INTERVAL 15 MINUTE) AS kept FROM w JOIN o ON o.k = w.k AND o.r = w.r + 1))
SELECT event_id, admitted FROM w WHERE r > 0""")
def login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("k"), "ts", (F.col("event_type") == "purchase").alias("success"))
    return limiters.sliding_log_table(rows, "k", "ts", "event_id", 2, 900.0, "success").select("event_id", "admitted")


KINDS = "SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'revoke' ELSE 'request' END AS kind FROM events"


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM ({KINDS})),
w AS (SELECT user_id, 0::BIGINT AS r, 0::BIGINT AS event_id, 'none' AS kind, NULL::TIMESTAMP AS expires, NULL::TIMESTAMP AS idle, NULL::TIMESTAMP AS seen, false AS admitted, false AS touched FROM (SELECT DISTINCT user_id FROM o)
 UNION ALL SELECT user_id, r, event_id, kind, CASE WHEN kind = 'login' THEN ts + INTERVAL 48 HOUR WHEN ok THEN expires END, CASE WHEN kind = 'login' THEN ts + INTERVAL 12 HOUR WHEN late THEN least(expires, ts + INTERVAL 12 HOUR) WHEN ok THEN idle END,
  CASE WHEN kind = 'login' OR late THEN ts WHEN ok THEN seen END, ok, late FROM (SELECT o.user_id, o.r, o.event_id, o.kind, o.ts, w.expires, w.idle, w.seen, coalesce(o.kind = 'request' AND o.ts < w.idle, false) AS ok, coalesce(o.kind = 'request' AND o.ts < w.idle AND o.ts - w.seen > INTERVAL 5 MINUTE, false) AS late FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1))
SELECT event_id, user_id, admitted, touched FROM w WHERE kind = 'request'""")
def session_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as logins, errors as revocations, all else as requests of a user's session."""
    kind = F.when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "error", "revoke").otherwise("request")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"))
    return limiters.session_requests(rows, "user_id", "ts", "event_id", "kind", 12 * 3600.0, 48 * 3600.0).select("event_id", "user_id", "admitted", "touched")
