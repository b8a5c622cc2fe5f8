"""The indexing state machine: queue rows, claims, recovery, change detection and progress.

States: PENDING, CLAIMED, PROCESSING, COMPLETED, FAILED. Every step is a pure function of the queue's rows; a row is in
one partition only, so a claim needs no lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensgraph.operators.ranks import placed

OPEN = ("CLAIMED", "PROCESSING")
DONE = ("COMPLETED", "FAILED")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], on_match: dict[str, Column] | None = None) -> DataFrame:
    """Rows of `base` with those of `changes` merged by key: new keys are added, known ones take the changed values.

    on_match: column -> expression over base.* (as b) and changes.* (as c), instead of the changed value. Keys compare
    null-safe and must be unique in `changes`.
    """
    b, c = base.alias("b"), changes.alias("c")
    same = None
    for k in keys:
        test = F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
        same = test if same is None else same & test
    marked_b, marked_c = base.withColumn("_in", F.lit(True)).alias("b"), changes.withColumn("_in", F.lit(True)).alias("c")
    joined = marked_b.join(marked_c, same, "full_outer")
    out = []
    for name in base.columns:
        if name in keys:
            value = F.when(F.col("b._in"), F.col(f"b.{name}")).otherwise(F.col(f"c.{name}"))
        elif name not in changes.columns:
            value = F.col(f"b.{name}")
        else:
            match = (on_match or {}).get(name, F.col(f"c.{name}"))
            value = F.when(F.col("c._in").isNull(), F.col(f"b.{name}")).when(F.col("b._in").isNull(), F.col(f"c.{name}")).otherwise(match)
        out.append(value.alias(name))
    return joined.select(*out)


def changes(before: DataFrame, after: DataFrame, key: str = "file_path", digest: str = "content_hash") -> DataFrame:
    """(key, change_type, old_hash, new_hash) of added, modified and deleted keys; unchanged ones are left out."""
    b, a = before.select(F.col(key).alias("_b"), F.col(digest).alias("old_hash")), after.select(F.col(key).alias("_a"), F.col(digest).alias("new_hash"))
    kind = F.when(F.col("_b").isNull(), "ADDED").when(F.col("_a").isNull(), "DELETED").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "MODIFIED")
    return b.join(a, F.col("_b") == F.col("_a"), "full_outer").select(F.coalesce("_a", "_b").alias(key), kind.alias("change_type"), "old_hash", "new_hash").filter("change_type is not null")


def pair_classes(pairs: DataFrame, changed: DataFrame, a: str, b: str, key: str = "file_path") -> DataFrame:
    """Adds `class`: INVALIDATED before CRITICAL_NEW before CRITICAL_MODIFIED before STABLE, by what changed at either end."""
    x, y = changed.select(F.col(key).alias(a), F.col("change_type").alias("_x")), changed.select(F.col(key).alias(b), F.col("change_type").alias("_y"))
    hit = lambda kind: F.coalesce(F.col("_x") == kind, F.lit(False)) | F.coalesce(F.col("_y") == kind, F.lit(False))
    name = F.when(hit("DELETED"), "INVALIDATED").when(hit("ADDED"), "CRITICAL_NEW").when(hit("MODIFIED"), "CRITICAL_MODIFIED").otherwise("STABLE")
    return pairs.join(x, a, "left").join(y, b, "left").withColumn("class", name).drop("_x", "_y")


def assign(tasks: DataFrame, workers: int, at: Column) -> DataFrame:
    """Claims all pending tasks at once: per session, in order of (priority, file_size, file_path), in turn for each worker.

    A session may hold any share of the queue: its order is cut into stretches.
    """
    mine = placed(tasks.filter("status = 'PENDING'"), ["session_id"], ["priority", "file_size", "file_path"], "turn")
    mine = mine.withColumn("turn", (F.col("turn") + 1).cast("int"))
    return mine.withColumn("claimed_by", F.concat(F.lit("agent-"), (F.pmod(F.col("turn") - 1, F.lit(workers)) + 1).cast("string"))).withColumn("claimed_at", at).withColumn("status", F.lit("CLAIMED"))


def move(tasks: DataFrame, moves: DataFrame, at: Column) -> DataFrame:
    """Applies (file_path, agent, status, message) to claimed tasks: PROCESSING, COMPLETED or FAILED.

    Only the agent that holds a claim may move it; other moves are without effect. Several moves of one task by its
    owner: the furthest counts (FAILED before COMPLETED before PROCESSING). A task that is done stays as it is.
    """
    order = F.when(F.col("status") == "FAILED", 3).when(F.col("status") == "COMPLETED", 2).otherwise(1)
    one = moves.filter(F.col("status").isin("PROCESSING", *DONE)).groupBy(F.col("file_path").alias("_path"), F.col("agent").alias("_agent")).agg(F.max_by(F.struct("status", "message"), F.struct(order, "message")).alias("_to"))
    joined = tasks.join(one, (F.col("file_path") == F.col("_path")) & (F.col("claimed_by") == F.col("_agent")) & F.col("status").isin(*OPEN), "left")
    hit, done = F.col("_to").isNotNull(), F.col("_to.status").isin(*DONE)
    changed = {"status": F.when(hit, F.col("_to.status")).otherwise(F.col("status")), "completed_at": F.when(hit & done, at).otherwise(F.col("completed_at")), "error_message": F.when(hit & (F.col("_to.status") == "FAILED"), F.col("_to.message")).otherwise(F.col("error_message"))}
    return joined.withColumns(changed).drop("_path", "_agent", "_to")


def populate(tasks: DataFrame, files: DataFrame, session: Column) -> DataFrame:
    """The queue after a discovery of files (file_path, file_size, priority) for a session.

    A new file is PENDING. A known file goes over to the session: done tasks of another session are PENDING again, any
    other status stays. Tasks of files that were not found stay as they are.
    """
    found = files.select(F.col("file_path").alias("_path"), F.col("file_size").alias("_size"), F.col("priority").alias("_priority")).dropDuplicates(["_path"])
    both = tasks.withColumn("_known", F.lit(True)).join(found, F.col("file_path") == F.col("_path"), "full")
    known, seen = F.coalesce("_known", F.lit(False)), F.col("_path").isNotNull()
    again = known & seen & F.col("status").isin(*DONE) & (F.col("session_id") != session)
    values = {
        "file_path": F.coalesce("file_path", "_path"),
        "status": F.when(~known | again, "PENDING").otherwise(F.col("status")),
        "session_id": F.when(seen, session).otherwise(F.col("session_id")),
        "retry_count": F.when(known, F.col("retry_count")).otherwise(0),
        "file_size": F.when(known, F.col("file_size")).otherwise(F.col("_size")),
        "priority": F.when(known, F.col("priority")).otherwise(F.col("_priority")),
    }
    return both.select(*[(values[c] if c in values else F.col(c)).alias(c) for c in tasks.columns])


def open_session(sessions: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """Sessions (namespace, session_id, status, started_at) after a request (namespace, session_id) each.

    A new namespace gets the session asked for, INITIALIZING; a COMPLETED one is INITIALIZING again under its own id,
    any other is resumed with its status.
    """
    asked = wanted.groupBy(F.col("namespace").alias("_n")).agg(F.min("session_id").alias("_s"))
    both = sessions.join(asked, F.col("namespace") == F.col("_n"), "full")
    new, met = F.col("namespace").isNull(), F.col("_n").isNotNull()
    return both.select(
        F.coalesce("namespace", "_n").alias("namespace"), F.when(new, F.col("_s")).otherwise(F.col("session_id")).alias("session_id"),
        F.when(new | (met & (F.col("status") == "COMPLETED")), "INITIALIZING").otherwise(F.col("status")).alias("status"), F.when(new, at).otherwise(F.col("started_at")).alias("started_at"),
    )


def recover_stale(tasks: DataFrame, now: Column, after: str = "interval 10 minutes") -> DataFrame:
    """Open claims older than `after` are pending again, with one more retry."""
    stale = F.col("status").isin(*OPEN) & (F.col("claimed_at") < now - F.expr(after))
    return tasks.withColumns({"retry_count": F.col("retry_count") + F.when(stale, 1).otherwise(0), "claimed_by": F.when(stale, F.lit(None)).otherwise(F.col("claimed_by")), "status": F.when(stale, "PENDING").otherwise(F.col("status"))})


def resume(tasks: DataFrame) -> DataFrame:
    """All open claims are pending again; retries stay."""
    open_ = F.col("status").isin(*OPEN)
    return tasks.withColumns({"claimed_by": F.when(open_, F.lit(None)).otherwise(F.col("claimed_by")), "status": F.when(open_, "PENDING").otherwise(F.col("status"))})


def retry(tasks: DataFrame, most: int = 3) -> DataFrame:
    """Failed tasks with fewer than `most` retries are pending again."""
    again = (F.col("status") == "FAILED") & (F.col("retry_count") < most)
    return tasks.withColumns({"retry_count": F.col("retry_count") + F.when(again, 1).otherwise(0), "status": F.when(again, "PENDING").otherwise(F.col("status"))})


def remaining(tasks: DataFrame, me: str) -> DataFrame:
    """Tasks that are not done and that another, or nobody, has claimed; an unclaimed task counts."""
    return tasks.filter(~F.col("status").isin(*DONE) & ~F.col("claimed_by").eqNullSafe(F.lit(me)))


def progress(tasks: DataFrame, *by: str) -> DataFrame:
    """Counts by state, share done in percent, and whether all are done."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    done = n("COMPLETED") + n("FAILED")
    return tasks.groupBy(*by).agg(F.count("*").alias("total"), *[n(s).alias(s.lower()) for s in ("PENDING", *OPEN, *DONE)], F.round(F.try_divide(done * 100.0, F.count("*")), 2).alias("percent"), (done >= F.count("*")).alias("finished"))


def route(changed: Column, total: Column) -> tuple[Column, Column]:
    """Two rules: by number (more than 10: parallel), and by share (under 1 % skip, under 10 % incremental, else full)."""
    share = F.try_divide(changed, total)
    return F.when(changed > 10, "PARALLEL").otherwise("SEQUENTIAL"), F.when(share < 0.01, "SKIP").when(share < 0.1, "INCREMENTAL").otherwise("FULL")


def needs_reindex(modified: Column, indexed: Column) -> Column:
    """Never indexed, or modified since."""
    return indexed.isNull() | (modified > indexed)


def eta_minutes(elapsed: Column, pending: Column, completed: Column) -> Column:
    """elapsed * pending / completed; null before anything is completed."""
    return F.try_divide(elapsed * pending, completed)


def solved_by(findings: DataFrame, solutions: DataFrame) -> DataFrame:
    """(src, dst, rel_type) from each finding (id, finding) to the solutions (id, reference) whose reference equals its text, once."""
    found = findings.select(F.col("id").alias("src"), "finding").dropna()
    given = solutions.select(F.col("id").alias("dst"), F.col("reference").alias("finding")).dropna()
    return found.join(given, "finding").select("src", "dst", F.lit("SOLVED_BY").alias("rel_type")).distinct()


def without_files(types: DataFrame, files: DataFrame) -> DataFrame:
    """Entity types (entity_type) that no file (entity_type) has: the second cohomology check holds if there are none."""
    return types.select("entity_type").distinct().join(files.select("entity_type").distinct(), "entity_type", "left_anti")
