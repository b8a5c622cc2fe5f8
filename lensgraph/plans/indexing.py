"""Queue, change and progress queries. Orders are file tasks, events are work reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensgraph.functions import scores, texts
from lensgraph.operators import calibrate, indexing
from lensgraph.sources.tables import table

NOW = "1999-06-01 00:00:00"
TASKS = f"""tasks AS (
  SELECT o_orderkey AS file_path, o_custkey % 4 AS session_id, substr(o_orderpriority, 1, 1)::INT AS priority, o_totalprice AS file_size,
         CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN (CASE WHEN o_orderkey % 3 = 0 THEN 'CLAIMED' ELSE 'PROCESSING' END) ELSE (CASE WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END) END AS status,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'agent-' || (o_custkey % 3 + 1) END AS claimed_by, o_orderdate AS claimed_at, (o_orderkey % 5)::INT AS retry_count
  FROM orders)"""


def tasks(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 3 == 0, "CLAIMED").otherwise("PROCESSING")).otherwise(F.when(F.col("o_orderkey") % 5 == 0, "FAILED").otherwise("COMPLETED"))
    who = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("agent-"), (F.col("o_custkey") % 3 + 1).cast("string")))
    return o.select(F.col("o_orderkey").alias("file_path"), (F.col("o_custkey") % 4).alias("session_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_totalprice").alias("file_size"), status.alias("status"), who.alias("claimed_by"), F.col("o_orderdate").alias("claimed_at"), (F.col("o_orderkey") % 5).cast("int").alias("retry_count"))


def now():
    return F.lit(NOW).cast("timestamp")


def claimed(spark, d):
    return indexing.assign(tasks(spark, d), 4, now()).select("file_path", "session_id", "turn", "claimed_by", "status")


def stale(spark, d):
    out = indexing.recover_stale(tasks(spark, d), now())
    return out.groupBy("session_id", "status").agg(F.count("*").alias("n"), F.sum("retry_count").alias("retries"), F.count("claimed_by").alias("claims"))


def moved(spark, d):
    """Agents report on orders by their lines: right and wrong owners, several reports of one task."""
    t = tasks(spark, d).withColumns({"completed_at": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string")})
    to = F.element_at(F.array(F.lit("PROCESSING"), F.lit("COMPLETED"), F.lit("FAILED")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    moves = table(spark, d, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("file_path"), F.concat(F.lit("agent-"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("agent"), to.alias("status"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("message"))
    return indexing.move(t, moves, now()).select("file_path", "status", F.col("completed_at").isNotNull().alias("ended"), "error_message")


def populated(spark, d):
    """Session 9 finds the orders whose number is not divisible by 7, and as many new files."""
    o = table(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("file_path"), F.col("o_totalprice").alias("file_size"), F.lit(3).alias("priority"))
    files = o.unionByName(o.withColumn("file_path", -F.col("file_path")))
    out = indexing.populate(tasks(spark, d), files, F.when(F.col("_path") % 2 == 0, 1).otherwise(9).cast("long"))
    return out.select("file_path", "session_id", "status", "retry_count", "priority", F.round("file_size", 2).alias("file_size"))


def sessions(spark, d):
    """Nations are namespaces; suppliers of small nations have sessions, customers ask for one."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("namespace")).agg(F.min("s_suppkey").alias("session_id"))
    s = s.withColumns({"status": F.when(F.col("session_id") % 2 == 0, "COMPLETED").otherwise("RUNNING"), "started_at": F.lit("1990-01-01").cast("timestamp")})
    wanted = table(spark, d, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("namespace"), (F.col("c_custkey") + 1000).alias("session_id"))
    return indexing.open_session(s, wanted, now())


def resumed(spark, d):
    return indexing.progress(indexing.resume(tasks(spark, d)), "session_id")


def retried(spark, d):
    return indexing.retry(tasks(spark, d)).groupBy("status").agg(F.count("*").alias("n"), F.sum("retry_count").alias("retries"))


def remaining(spark, d):
    return indexing.remaining(tasks(spark, d), "agent-1").groupBy("session_id", "status").agg(F.count("*").alias("n"))


def dashboard(spark, d):
    p = indexing.progress(tasks(spark, d), "session_id")
    e = tasks(spark, d).groupBy("session_id").agg(F.countDistinct("claimed_by").alias("agents"), F.timestamp_diff("MINUTE", F.min("claimed_at"), now()).alias("elapsed"))
    return p.join(e, "session_id").withColumn("eta", F.round(indexing.eta_minutes(F.col("elapsed"), F.col("pending"), F.col("completed")), 4))


def _versions(spark, d):
    """Yesterday's and today's hash of each part: prices of small parts changed, large ones are new, some are gone."""
    p = table(spark, d, "part")
    digest = lambda c: texts.short_hash(c.cast("string"))
    before = p.filter("p_size <= 45").select(F.col("p_partkey").alias("file_path"), digest(F.concat_ws("|", "p_name", "p_brand")).alias("content_hash"))
    after = p.filter("p_size > 3").select(F.col("p_partkey").alias("file_path"), digest(F.when(F.col("p_size") < 10, F.concat_ws("|", "p_name", "p_type")).otherwise(F.concat_ws("|", "p_name", "p_brand"))).alias("content_hash"))
    return before, after


VERSIONS = """old_files AS (SELECT p_partkey AS f, substr(sha256(p_name || '|' || p_brand), 1, 8) AS h FROM part WHERE p_size <= 45),
new_files AS (SELECT p_partkey AS f, substr(sha256(CASE WHEN p_size < 10 THEN p_name || '|' || p_type ELSE p_name || '|' || p_brand END), 1, 8) AS h FROM part WHERE p_size > 3),
changed AS (SELECT coalesce(n.f, o.f) AS file_path, CASE WHEN o.f IS NULL THEN 'ADDED' WHEN n.f IS NULL THEN 'DELETED' WHEN o.h <> n.h THEN 'MODIFIED' END AS change_type, o.h AS old_hash, n.h AS new_hash FROM old_files o FULL JOIN new_files n ON o.f = n.f)"""


def detected(spark, d):
    return indexing.changes(*_versions(spark, d))


def incremental(spark, d):
    """Discount and tax stand for the score that a pair should have and the cosine that it has."""
    lines = table(spark, d, "lineitem")
    pairs = lines.select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") + F.col("l_suppkey")) % 200).alias("b"), F.col("l_discount").cast("double").alias("target"), F.col("l_tax").cast("double").alias("cosine"))
    cells = table(spark, d, "nation").select((F.col("n_nationkey") / 25).alias("old"), (F.col("n_regionkey") / 5).alias("new"))
    out = calibrate.incremental_loss(indexing.pair_classes(pairs, detected(spark, d), "a", "b"), cells)
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


INCREMENTAL_SQL = f"""WITH {VERSIONS}, pairs AS (SELECT l_partkey AS a, (l_partkey + l_suppkey) % 200 AS b, power(l_discount::DOUBLE - l_tax::DOUBLE, 2) AS e FROM lineitem),
t AS (SELECT e, coalesce(x.change_type, '-') AS x, coalesce(y.change_type, '-') AS y FROM pairs LEFT JOIN changed x ON x.file_path = a LEFT JOIN changed y ON y.file_path = b),
k AS (SELECT avg(e) FILTER (WHERE 'ADDED' IN (x, y) OR 'MODIFIED' IN (x, y)) AS critical, avg(e) FILTER (WHERE x = '-' AND y = '-') AS memory FROM t WHERE 'DELETED' NOT IN (x, y)),
m AS (SELECT sum(power(n_regionkey::DOUBLE / 5 - n_nationkey::DOUBLE / 25, 2)) AS anchor FROM nation)
SELECT round(critical, 8) AS critical, round(memory, 8) AS memory, round(anchor, 8) AS anchor, round(critical + 0.5::DOUBLE * memory + 0.1::DOUBLE * anchor, 8) AS total FROM k, m"""


def revalidated(spark, d):
    """An order is validated on its date, urgent ones never."""
    seen = F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderdate").cast("timestamp"))
    o = table(spark, d, "orders").withColumn("seen", seen)
    return o.filter(scores.needs_revalidation(F.col("seen"), F.lit(NOW).cast("timestamp"), 700)).select("o_orderkey", F.col("seen").isNull().alias("never"))


def scheduled(spark, d):
    """Per customer: open orders are changed files, the share of pending ones is the drift."""
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("changed"), F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("drifted"))
    return by.select("o_custkey", "changed", scores.calibration_action(F.col("changed"), F.col("drifted")).alias("action"))


def new_file_set(spark, d):
    before, _ = _versions(spark, d)
    c = indexing.changes(*_versions(spark, d))
    kept = before.select("file_path").join(c.filter("change_type = 'DELETED'"), "file_path", "left_anti")
    return kept.unionByName(c.filter("change_type = 'ADDED'").select("file_path"))


def pair_classes(spark, d):
    c = indexing.changes(*_versions(spark, d))
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") + F.col("l_suppkey")) % 200).alias("b"))
    return indexing.pair_classes(pairs, c, "a", "b").groupBy("class").agg(F.count("*").alias("pairs"))


def routing(spark, d):
    c = indexing.changes(*_versions(spark, d)).agg(F.count("*").alias("changed"))
    t = table(spark, d, "part").agg(F.count("*").alias("total"))
    by_number, by_share = indexing.route(F.col("changed"), F.col("total"))
    return c.crossJoin(t).select("changed", "total", by_number.alias("by_number"), by_share.alias("by_share"))


def affected(spark, d):
    """Entities (suppliers) implemented in changed files."""
    c = indexing.changes(*_versions(spark, d)).select(F.col("file_path").alias("l_partkey"))
    return table(spark, d, "lineitem").join(c, "l_partkey", "left_semi").select("l_suppkey").distinct()


def upserted(spark, d):
    """Customers as stored sessions, orders of one month as changes: balance is added on a match."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"), F.col("c_acctbal").alias("amount"))
    new = table(spark, d, "orders").filter("o_orderdate >= '1997-01-01' and o_orderdate < '1997-02-01'").groupBy(F.when(F.col("o_custkey") % 10 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).alias("id")).agg(F.lit("SEEN").alias("state"), F.sum("o_totalprice").alias("amount"))
    out = indexing.upsert(base, new, ["id"], {"amount": F.col("b.amount") + F.col("c.amount")})
    return out.select("id", "state", F.round("amount", 2).alias("amount"))


def reindex(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified"))
    ev = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("indexed"))
    j = o.join(ev, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.filter(indexing.needs_reindex(F.col("modified"), F.col("indexed"))).select("o_orderkey", F.col("indexed").isNull().alias("never"))


def rolling_latency(spark, d):
    """Hourly windows: mean value as latency, with the two flags."""
    e = table(spark, d, "events")
    w = e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("a"), F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("a", 6).alias("latency"), (F.col("a") > 200).alias("optimize"), (F.col("a") < 100).alias("healthy"))


def recent_work(spark, d):
    last = table(spark, d, "events").agg(F.max("ts").alias("until"))
    e = table(spark, d, "events").crossJoin(F.broadcast(last)).filter(F.col("ts") > F.col("until") - F.expr("interval 1 day"))  # one row
    return e.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.count("*").alias("commits")).select("user_id", F.concat_ws(",", "kinds").alias("kinds"), "commits")


def plans_with_tasks(spark, d):
    o, l = table(spark, d, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"), table(spark, d, "lineitem")
    j = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.concat_ws(";", F.sort_array(F.collect_list(F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_returnflag"))))).alias("tasks"))


def pending_by_priority(spark, d):
    return tasks(spark, d).filter("status = 'PENDING'").groupBy("priority").agg(F.count("*").alias("n"), F.min("file_size").alias("least"), F.max("file_size").alias("most"))


def status_pivot(spark, d):
    return tasks(spark, d).groupBy("session_id").pivot("status", ["PENDING", "CLAIMED", "PROCESSING", "COMPLETED", "FAILED"]).count().na.fill(0)


PROGRESS = "count(*) AS total, sum((status = 'PENDING')::INT)::BIGINT AS pending, sum((status = 'CLAIMED')::INT)::BIGINT AS claimed, sum((status = 'PROCESSING')::INT)::BIGINT AS processing, sum((status = 'COMPLETED')::INT)::BIGINT AS completed, sum((status = 'FAILED')::INT)::BIGINT AS failed, round(sum((status IN ('COMPLETED', 'FAILED'))::INT) * 100.0::DOUBLE / count(*), 2) AS percent, sum((status IN ('COMPLETED', 'FAILED'))::INT) >= count(*) AS finished"

QUERIES = {
    "index_claims": (claimed, f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority, file_size, file_path)::INT AS turn FROM tasks WHERE status = 'PENDING') SELECT file_path, session_id, turn, 'agent-' || ((turn - 1) % 4 + 1) AS claimed_by, 'CLAIMED' AS status FROM r"),
    "index_moves": (moved, f"WITH {TASKS}, m AS (SELECT l_orderkey AS p, 'agent-' || (l_suppkey % 3 + 1) AS agent, max(CASE l_linenumber % 3 WHEN 0 THEN 1 ELSE l_linenumber % 3 + 1 END) AS step, max(CASE WHEN l_linenumber % 3 = 2 THEN 'line ' || l_linenumber END) AS message FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), j AS (SELECT tasks.*, step, message FROM tasks LEFT JOIN m ON p = file_path AND agent = claimed_by AND status IN ('CLAIMED', 'PROCESSING')) SELECT file_path, CASE step WHEN 3 THEN 'FAILED' WHEN 2 THEN 'COMPLETED' WHEN 1 THEN 'PROCESSING' ELSE status END AS status, coalesce(step >= 2, false) AS ended, CASE WHEN step = 3 THEN message END AS error_message FROM j"),
    "index_populate": (populated, f"WITH {TASKS}, f AS (SELECT o_orderkey * s AS p, o_totalprice AS size FROM orders, (VALUES (1), (-1)) v(s) WHERE o_orderkey % 7 <> 0), j AS (SELECT *, CASE WHEN p % 2 = 0 THEN 1 ELSE 9 END AS want FROM tasks FULL JOIN f ON p = file_path) SELECT coalesce(file_path, p) AS file_path, CASE WHEN p IS NULL THEN session_id ELSE want END::BIGINT AS session_id, CASE WHEN file_path IS NULL OR (p IS NOT NULL AND status IN ('COMPLETED', 'FAILED') AND session_id <> want) THEN 'PENDING' ELSE status END AS status, CASE WHEN file_path IS NULL THEN 0 ELSE retry_count END::INT AS retry_count, CASE WHEN file_path IS NULL THEN 3 ELSE priority END::INT AS priority, round(CASE WHEN file_path IS NULL THEN size ELSE file_size END, 2) AS file_size FROM j"),
    "index_sessions": (sessions, f"WITH s AS (SELECT s_nationkey AS n, min(s_suppkey) AS sid FROM supplier GROUP BY 1), w AS (SELECT c_nationkey AS n, min(c_custkey + 1000) AS sid FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) SELECT coalesce(s.n, w.n) AS namespace, coalesce(s.sid, w.sid) AS session_id, CASE WHEN s.n IS NULL OR (w.n IS NOT NULL AND s.sid % 2 = 0) THEN 'INITIALIZING' WHEN s.sid % 2 = 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS status, CASE WHEN s.n IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '1990-01-01' END AS started_at FROM s FULL JOIN w ON s.n = w.n"),
    "index_stale_recovery": (stale, f"WITH {TASKS}, r AS (SELECT *, status IN ('CLAIMED', 'PROCESSING') AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AS late FROM tasks), u AS (SELECT session_id, CASE WHEN late THEN 'PENDING' ELSE status END AS status, retry_count + late::INT AS retry_count, CASE WHEN late THEN NULL ELSE claimed_by END AS claimed_by FROM r) SELECT session_id, status, count(*) AS n, sum(retry_count)::BIGINT AS retries, count(claimed_by) AS claims FROM u GROUP BY session_id, status"),
    "index_resume": (resumed, f"WITH {TASKS}, u AS (SELECT session_id, CASE WHEN status IN ('CLAIMED', 'PROCESSING') THEN 'PENDING' ELSE status END AS status FROM tasks) SELECT session_id, {PROGRESS} FROM u GROUP BY session_id"),
    "index_retry": (retried, f"WITH {TASKS}, u AS (SELECT CASE WHEN status = 'FAILED' AND retry_count < 3 THEN 'PENDING' ELSE status END AS status, retry_count + (status = 'FAILED' AND retry_count < 3)::INT AS retry_count FROM tasks) SELECT status, count(*) AS n, sum(retry_count)::BIGINT AS retries FROM u GROUP BY status"),
    "index_remaining": (remaining, f"WITH {TASKS} SELECT session_id, status, count(*) AS n FROM tasks WHERE status NOT IN ('COMPLETED', 'FAILED') AND claimed_by IS DISTINCT FROM 'agent-1' GROUP BY session_id, status"),
    "index_dashboard": (dashboard, f"WITH {TASKS}, p AS (SELECT session_id, {PROGRESS}, count(DISTINCT claimed_by) AS agents, floor(epoch(TIMESTAMP '{NOW}' - min(claimed_at)) / 60)::BIGINT AS elapsed FROM tasks GROUP BY session_id) SELECT *, round(elapsed * pending / completed::DOUBLE, 4) AS eta FROM p"),
    "index_changes": (detected, f"WITH {VERSIONS} SELECT * FROM changed WHERE change_type IS NOT NULL"),
    "index_new_file_set": (new_file_set, f"WITH {VERSIONS} SELECT f AS file_path FROM old_files WHERE f NOT IN (SELECT file_path FROM changed WHERE change_type = 'DELETED') UNION ALL SELECT file_path FROM changed WHERE change_type = 'ADDED'"),
    "index_pair_classes": (pair_classes, f"WITH {VERSIONS}, pairs AS (SELECT l_partkey AS a, (l_partkey + l_suppkey) % 200 AS b FROM lineitem), t AS (SELECT x.change_type AS x, y.change_type AS y FROM pairs LEFT JOIN changed x ON x.file_path = a LEFT JOIN changed y ON y.file_path = b) SELECT CASE WHEN x = 'DELETED' OR y = 'DELETED' THEN 'INVALIDATED' WHEN x = 'ADDED' OR y = 'ADDED' THEN 'CRITICAL_NEW' WHEN x = 'MODIFIED' OR y = 'MODIFIED' THEN 'CRITICAL_MODIFIED' ELSE 'STABLE' END AS class, count(*) AS pairs FROM t GROUP BY 1"),
    "calibration_incremental_loss": (incremental, INCREMENTAL_SQL),
    "calibration_schedule": (scheduled, "WITH b AS (SELECT o_custkey, sum((o_orderstatus = 'O')::INT)::BIGINT AS changed, avg((o_orderstatus = 'P')::INT) AS drifted FROM orders GROUP BY o_custkey) SELECT o_custkey, changed, CASE WHEN drifted > 0.1::DOUBLE THEN 'FULL' WHEN changed > 5 THEN 'INCREMENTAL' WHEN changed > 0 THEN 'CACHE' END AS action FROM b"),
    "index_revalidation": (revalidated, f"WITH s AS (SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderdate::TIMESTAMP END AS seen FROM orders) SELECT o_orderkey, seen IS NULL AS never FROM s WHERE seen IS NULL OR seen < TIMESTAMP '{NOW}' - INTERVAL 700 DAY"),
    "index_routing": (routing, f"WITH {VERSIONS}, c AS (SELECT count(*) AS changed FROM changed WHERE change_type IS NOT NULL), t AS (SELECT count(*) AS total FROM part) SELECT changed, total, CASE WHEN changed > 10 THEN 'PARALLEL' ELSE 'SEQUENTIAL' END AS by_number, CASE WHEN changed / total::DOUBLE < 0.01 THEN 'SKIP' WHEN changed / total::DOUBLE < 0.1 THEN 'INCREMENTAL' ELSE 'FULL' END AS by_share FROM c, t"),
    "index_affected_set": (affected, f"WITH {VERSIONS} SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT file_path FROM changed WHERE change_type IS NOT NULL)"),
    "index_upsert": (upserted, "WITH new AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS id, sum(o_totalprice) AS amount FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1997-02-01' GROUP BY 1) SELECT coalesce(c_custkey, id) AS id, CASE WHEN id IS NULL THEN c_mktsegment ELSE 'SEEN' END AS state, round(CASE WHEN id IS NULL THEN c_acctbal WHEN c_custkey IS NULL THEN amount ELSE c_acctbal + amount END, 2) AS amount FROM customer FULL JOIN new ON c_custkey = id"),
    "index_reindex": (reindex, "WITH i AS (SELECT l_orderkey, min(l_shipdate) AS indexed FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, indexed IS NULL AS never FROM orders LEFT JOIN i ON l_orderkey = o_orderkey WHERE indexed IS NULL OR o_orderdate > indexed"),
    "stream_rolling_latency": (rolling_latency, "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, round(avg(value), 6) AS latency, avg(value) > 200 AS optimize, avg(value) < 100 AS healthy FROM events GROUP BY 1"),
    "index_recent_work": (recent_work, "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) AS commits FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY user_id"),
    "index_active_plans": (plans_with_tasks, "SELECT o_orderkey, string_agg(l_partkey || ':' || l_returnflag, ';' ORDER BY l_partkey || ':' || l_returnflag) AS tasks FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY o_orderkey"),
    "index_pending_by_priority": (pending_by_priority, f"WITH {TASKS} SELECT priority, count(*) AS n, min(file_size) AS least, max(file_size) AS most FROM tasks WHERE status = 'PENDING' GROUP BY priority"),
    "index_status_pivot": (status_pivot, f"WITH {TASKS} SELECT session_id, sum((status = 'PENDING')::INT)::BIGINT AS \"PENDING\", sum((status = 'CLAIMED')::INT)::BIGINT AS \"CLAIMED\", sum((status = 'PROCESSING')::INT)::BIGINT AS \"PROCESSING\", sum((status = 'COMPLETED')::INT)::BIGINT AS \"COMPLETED\", sum((status = 'FAILED')::INT)::BIGINT AS \"FAILED\" FROM tasks GROUP BY session_id"),
}
