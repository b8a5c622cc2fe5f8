"""Queries through encoders, scorers and streams, with the default models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lensgraph.functions.vectors import cosine, mrl_truncate, norm
from lensgraph.operators import models
from lensgraph.shared import new_folder
from lensgraph.sources import files
from lensgraph.sources.tables import LINKS_SQL, edges, nodes, table, table_stream
from lensgraph.streaming import watch

LENS_TEXTS = {"structural": "Describe the structure", "semantic": "Describe the meaning", "behavioral": "Describe the behavior"}


def embed(spark, d):
    out = models.encode(table(spark, d, "benchmark"), models.HashingEncoder(256), "text", ["item_id"])
    return out.select("item_id", F.size("embedding").alias("width"), F.round(norm(F.col("embedding")), 4).alias("norm"), F.round(norm(mrl_truncate(F.col("embedding"), 128)), 4).alias("cut_norm"))


def embed_triple(spark, d):
    out = models.encode_lenses(table(spark, d, "benchmark"), models.HashingEncoder(128), models.lens_table(spark, LENS_TEXTS), "item_id")
    return out.groupBy("lens", "lens_hash").agg(F.count("*").alias("vectors"))


def embedding_cache(spark, d):
    """Half of the texts are in the cache, a day old at most."""
    t = table(spark, d, "benchmark")
    enc, lens = models.HashingEncoder(128), F.lit("semantic")
    stored = models.encode(t.filter("item_id % 2 = 0"), enc, "text", ["text"]).select(models.cache_key(F.col("text"), lens, 128).alias("cache_key"), "embedding", F.current_timestamp().alias("cached_at"))
    return models.cached(t, stored, enc, lens, 128, F.current_timestamp() - F.expr("interval 1 day")).groupBy("hit").agg(F.count("*").alias("texts"))


def score_pairs(spark, d):
    c = table(spark, d, "conversations")
    a, b = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("ta"), F.col("text").alias("a")), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("ta"), F.col("text").alias("b"))
    out = models.score(a.join(b, ["conv_id", "ta"]), models.OverlapScorer(), "a", "b", symmetric=True)
    return out.groupBy("interpretation").agg(F.count("*").alias("pairs"))


def rerank(spark, d):
    c = table(spark, d, "conversations")
    q = c.filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("query")).withColumnRenamed("conv_id", "query_id")
    docs = c.filter("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), F.col("text").alias("document"))
    return models.rerank(q, docs, models.OverlapScorer(), 3).select("query_id", "doc_id", "rank", "interpretation")


def embed_request(spark, d):
    t = table(spark, d, "nation").filter("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("text"))
    return models.request(t, models.HashingEncoder(256), "semantic", 128).select("status", "idx", F.size("embedding").alias("width"))


def lens_versions(spark, d):
    stored = models.lens_table(spark, LENS_TEXTS | {"semantic": "An older text"})
    return models.lens_current(stored, models.lens_table(spark, LENS_TEXTS)).select("lens", "current")


def graph_export(spark, d):
    folder = new_folder(spark, "graph")
    files.write_graph(nodes(spark, d), edges(spark, d), folder)
    n, e = files.read_graph(spark, folder)
    return e.groupBy("rel_type").agg(F.count("*").alias("edges")).crossJoin(n.agg(F.count("*").alias("nodes")))


def divergence_report(spark, d):
    """Cosine of the encoder against the scorer, for questions and their answers."""
    c = table(spark, d, "conversations")
    a, b = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("ta"), F.col("text").alias("a")), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("ta"), F.col("text").alias("b"))
    s = models.score(a.join(b, ["conv_id", "ta"]), models.OverlapScorer(), "a", "b")
    enc = models.HashingEncoder(256)
    s = models.encode(s, enc, "a", ["conv_id", "ta", "b", "score"]).withColumnRenamed("embedding", "va")
    s = models.encode(s, enc, "b", ["conv_id", "ta", "score", "va"])
    g = cosine(F.col("va"), F.col("embedding")) - F.col("score")
    return s.agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(g)), 4).alias("divergence"))


def streamed_latency(spark, d):
    """The same hourly means through a stream over the table's folder (complete mode, all rows)."""
    events = table_stream(spark, d, "events", ["ts", "value"])
    out = watch.drained(watch.latency(events, late="60 days"), f"latency_{uuid.uuid4().hex}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("latency", 6).alias("latency"), "optimize", "healthy")


#: Distinct words of a text, and the score of a by b.
WORDS = "list_distinct(string_split_regex(trim(lower({t})), '\\s+'))"
ONE = "1 / (1 + exp(4 - 8 * (len(list_intersect({a}, {b}))::DOUBLE / len({a}))))"
SCORED_PAIRS = f"""c AS (SELECT conv_id, turn, role, {WORDS.format(t="text")} AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
s AS (SELECT ({ONE.format(a="a", b="b")} + {ONE.format(a="b", b="a")}) / 2 AS score FROM p)"""

QUERIES = {
    "model_embed": (embed, None),
    "model_embed_triple": (embed_triple, "SELECT lens, substr(sha256(t), 1, 8) AS lens_hash, (SELECT count(*) FROM benchmark) AS vectors FROM (VALUES ('structural', 'Describe the structure'), ('semantic', 'Describe the meaning'), ('behavioral', 'Describe the behavior')) l(lens, t)"),
    "model_embedding_cache": (embedding_cache, "SELECT hit, count(*) AS texts FROM (SELECT text, bool_or(item_id % 2 = 0) AS hit FROM benchmark GROUP BY text) GROUP BY hit"),
    "model_score_pairs": (score_pairs, f"WITH {SCORED_PAIRS} SELECT CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS interpretation, count(*) AS pairs FROM s GROUP BY 1"),
    "model_rerank": (rerank, None),
    "model_embed_request": (embed_request, "SELECT 200 AS status, n_nationkey::BIGINT AS idx, 128 AS width FROM nation WHERE n_nationkey < 5"),
    "model_lens_versions": (lens_versions, "SELECT * FROM (VALUES ('structural', true), ('semantic', false), ('behavioral', true)) v(lens, current)"),
    "model_divergence": (divergence_report, None),
    "sink_graph_export": (graph_export, f"WITH {LINKS_SQL.strip()} SELECT rel_type, count(*) AS edges, (SELECT count(*) FROM part) AS nodes FROM edges GROUP BY rel_type"),
    "stream_latency": (streamed_latency, "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, round(avg(value), 6) AS latency, avg(value) > 200 AS optimize, avg(value) < 100 AS healthy FROM events GROUP BY 1"),
}
