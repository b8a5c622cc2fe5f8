"""Queries over requests to models, sinks, rules by phase and dashboards of calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensgraph.functions import texts
from lensgraph.operators import indexing, models
from lensgraph.plans.vectors import SCORED, _scored
from lensgraph.shared import new_folder
from lensgraph.sources import files
from lensgraph.sources.tables import LINKS_SQL, edges, nodes, table

#: Share of a's distinct words that are in b, and the score of one direction.
SHARE = "len(list_intersect({a}, {b}))::DOUBLE / len({a})"
ONE = f"1 / (1 + exp(4 - 8 * {SHARE}))"
WORDS = "list_distinct(string_split_regex(trim(lower({t})), '\\s+'))"
READING = "CASE WHEN {s} >= 0.7 THEN 'HIGH' WHEN {s} >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"


def pair_ids(spark, d):
    """Each turn against the next of its conversation, by id; the last of each has none."""
    c = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    pairs = c.select(F.col("id").alias("pair_id"), F.col("id").alias("a_id"), F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("b_id"))
    out = models.score_by_id(pairs, c.select("id", "text"), models.OverlapScorer(), symmetric=True)
    return out.select("pair_id", F.round("score", 6).alias("score"), "status")


PAIR_SQL = f"""WITH c AS (SELECT conv_id || ':' || turn AS id, conv_id || ':' || (turn + 1) AS next, {WORDS.format(t="text")} AS w, text FROM conversations)
SELECT c.id AS pair_id, round(({ONE.format(a="c.w", b="n.w")} + {ONE.format(a="n.w", b="c.w")}) / 2, 6) AS score, CASE WHEN n.text IS NULL OR c.text IS NULL THEN 'MISSING' ELSE 'OK' END AS status FROM c LEFT JOIN c n ON n.id = c.next"""


def batch_scores(spark, d):
    """A conversation's first turn against all its turns, in order."""
    c = table(spark, d, "conversations")
    r = c.groupBy(F.col("conv_id").alias("request_id")).agg(F.min_by("text", "turn").alias("query"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("documents"))
    return models.score_batch(r, models.OverlapScorer()).select("request_id", "position", F.round("score", 6).alias("score"), "interpretation")


BATCH_SQL = f"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS position, {WORDS.format(t="text")} AS w, first_value({WORDS.format(t="text")}) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
s AS (SELECT conv_id AS request_id, position::INT AS position, {ONE.format(a="q", b="w")} AS score FROM c) SELECT request_id, position, round(score, 6) AS score, {READING.format(s="score")} AS interpretation FROM s"""


def model_info(spark, d):
    from lensgraph.plans.models import LENS_TEXTS

    out = models.model_info(spark, models.HashingEncoder(256), models.lens_table(spark, LENS_TEXTS))
    return out.select("model_id", F.explode("lens_hashes").alias("lens", "lens_hash"), F.col("at").isNotNull().alias("timed"))


def prompts(spark, d):
    """Questions within a budget of 12 words, of which the frame takes 4."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", texts.cut_words(F.col("text"), 12, "Judge the document:", "Answer:").alias("prompt"))


PROMPT_SQL = "SELECT conv_id, turn, concat_ws(' ', 'Judge the document:', nullif(array_to_string(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:8], ' '), ''), 'Answer:') AS prompt FROM conversations"


def appended(spark, d):
    """A graph written in two parts, the second added to the first."""
    folder, n, e = new_folder(spark, "graph"), nodes(spark, d), edges(spark, d)
    for k, mode in ((0, "overwrite"), (1, "append")):
        files.write_graph(n.filter(f"id % 2 = {k}"), e.filter(f"src % 2 = {k}"), folder, mode=mode)
    back, links = files.read_graph(spark, folder)
    return links.groupBy("rel_type").agg(F.count("*").alias("edges"), F.sum("frequency").alias("frequency")).crossJoin(back.agg(F.count("*").alias("nodes")))  # one row


def json_sink(spark, d):
    folder = new_folder(spark, "json")
    files.write_json(nodes(spark, d), folder)
    return spark.read.schema("id long, name string, kind string, size int").json(folder)


def phased(spark, d):
    """Parts by name, then by brand, then by type; what a later phase says stands."""
    n = table(spark, d, "part")
    phases = [
        [(F.col("p_name"), "(bolt|nut)$", "FASTENER", 0.9), (F.col("p_name"), "^red", "RED", 0.9)],
        [(F.col("p_brand"), "(?i)brand#1[0-9]$", "TEEN", 0.85)],
        [(F.col("p_type"), "^PROMO$", "PROMOTED", 0.95)],
    ]
    label, sure = texts.phased(phases)
    return n.select(F.col("p_partkey").alias("id"), F.coalesce(label, F.lit("OTHER")).alias("label"), F.coalesce(sure, F.lit(0.0)).alias("confidence"))


PHASED_SQL = """WITH x AS (SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'PROMOTED' WHEN regexp_matches(p_brand, '(?i)brand#1[0-9]$') THEN 'TEEN' WHEN regexp_matches(p_name, '(bolt|nut)$') THEN 'FASTENER' WHEN p_name LIKE 'red%' THEN 'RED' ELSE 'OTHER' END AS label FROM part)
SELECT id, label, CASE label WHEN 'PROMOTED' THEN 0.95::DOUBLE WHEN 'TEEN' THEN 0.85 WHEN 'OTHER' THEN 0.0 ELSE 0.9 END AS confidence FROM x"""


def indexed(spark, d):
    """Parts as code elements: the type tells what they are, the size their lines, the price their complexity."""
    n = table(spark, d, "part")
    kind, size = F.col("p_type"), F.col("p_size")
    marks = F.when(F.col("p_brand") == "Brand#7", F.array(F.lit("@Service"))).when(F.col("p_brand") == "Brand#8", F.array(F.lit("@Deprecated"), F.lit("@Component"))).otherwise(F.array(F.lit("@Override")))
    met = texts.indexed(kind == "STANDARD", kind == "SMALL", kind == "PROMO", size, kind == "LARGE", marks, F.col("p_retailprice") % 30)
    return n.filter(met).select(F.col("p_partkey").alias("id"), kind.alias("kind"))


def calibration_dashboard(spark, d):
    """Pairs scored so far (every third is still to come), mean divergence and what it says."""
    p = _scored(spark, d).withColumn("open", F.pmod(F.col("row_id"), F.lit(3)) == 0)
    out = p.agg(F.count(F.when(F.col("open"), 1)).alias("pending"), F.count(F.when(~F.col("open"), 1)).alias("completed"), F.avg(F.when(~F.col("open"), F.col("cosine") - F.col("score"))).alias("g"))
    said = F.when(F.col("g") > 0.4, "HIGH").when(F.col("g") > 0.2, "MODERATE").otherwise("LOW")
    return out.select("pending", "completed", F.round(F.try_divide(F.col("completed") * 100.0, F.col("pending") + F.col("completed")), 6).alias("progress"), F.round("g", 6).alias("average"), said.alias("interpretation"))


def fallback(spark, d):
    """Prompts of the parts: every second part has an instruction of its own."""
    n = table(spark, d, "part")
    own = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Judge "), "p_type"))
    return n.select(F.col("p_partkey").alias("id"), F.md5(texts.rerank_prompt(F.col("p_name"), F.col("p_brand"), own).cast("binary")).alias("prompt"))


def embedded(spark, d):
    """Components that are not 0 of the vectors of the benchmark's texts, with a lens's instruction before them."""
    t = table(spark, d, "benchmark").select("item_id", texts.instruct(F.col("text"), F.lit("Describe the meaning")).alias("said"))
    out = models.encode(t, models.HashingEncoder(64, digest="md5"), "said", ["item_id"])
    return out.select("item_id", F.posexplode("embedding").alias("place", "value")).filter("value <> 0").select("item_id", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


EMBEDDED_SQL = f"""WITH w AS (SELECT item_id, unnest(string_split_regex(trim(lower('Instruct: Describe the meaning' || chr(10) || 'Query: ' || text)), '\\s+')) AS w FROM benchmark),
h AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS place, CASE WHEN substr(md5(w), 9, 1) > '7' THEN 1 ELSE -1 END AS sign FROM w),
v AS (SELECT item_id, place, sum(sign) AS x FROM h GROUP BY item_id, place), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM v GROUP BY item_id)
SELECT item_id, place::INT AS place, round((x / n)::DOUBLE, 5) AS value FROM v JOIN n USING (item_id) WHERE x <> 0"""


def solved(spark, d):
    """Errors of a user as findings, purchases as solutions; both name the hour of their kind."""
    e = table(spark, d, "events").select("event_id", "event_type", F.concat_ws(" ", F.lit("user"), "user_id", F.lit("hour"), F.hour("ts")).alias("said"))
    return indexing.solved_by(e.filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("said").alias("finding")), e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("said").alias("reference")))


def typeless(spark, d):
    """Nations that no supplier of a negative balance has."""
    types = table(spark, d, "nation").select(F.col("n_name").alias("entity_type"), "n_nationkey")
    have = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return indexing.without_files(types, types.join(have, "n_nationkey"))


def relative(spark, d):
    u = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "/").alias("path"), "url")
    return u.select("page_id", texts.relative_path(F.concat(F.lit("/srv/"), F.element_at(F.split("path", "/"), -1)), "/srv/").alias("below"), texts.relative_path(F.col("url"), "/srv").alias("same"))


QUERIES = {
    "model_embed_values": (embedded, EMBEDDED_SQL),
    "index_solved_by": (solved, "WITH e AS (SELECT event_id, event_type, user_id, hour(ts) AS h FROM events) SELECT a.event_id AS src, b.event_id AS dst, 'SOLVED_BY' AS rel_type FROM e a JOIN e b USING (user_id, h) WHERE a.event_type = 'error' AND b.event_type = 'purchase'"),
    "graph_types_without_files": (typeless, "SELECT n_name AS entity_type FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)"),
    "text_relative_path": (relative, "SELECT page_id, CASE WHEN string_split(regexp_replace(url, '^[a-z]+://', '/'), '/')[-1] = '' THEN '' ELSE string_split(regexp_replace(url, '^[a-z]+://', '/'), '/')[-1] END AS below, url AS same FROM pages"),
    "text_prompt_fallback": (fallback, f"SELECT p_partkey AS id, md5('<Instruct>: ' || CASE WHEN p_partkey % 2 = 0 THEN 'Judge ' || p_type ELSE '{texts.INSTRUCTION}' END || chr(10) || '<Query>: ' || p_name || chr(10) || '<Document>: ' || p_brand) AS prompt FROM part"),
    "model_pair_scores": (pair_ids, PAIR_SQL),
    "model_batch_scores": (batch_scores, BATCH_SQL),
    "model_info": (model_info, "SELECT 'hashing-encoder-256' AS model_id, lens, substr(sha256(t), 1, 8) AS lens_hash, true AS timed FROM (VALUES ('structural', 'Describe the structure'), ('semantic', 'Describe the meaning'), ('behavioral', 'Describe the behavior')) l(lens, t)"),
    "text_prompt_budget": (prompts, PROMPT_SQL),
    "sink_graph_append": (appended, f"WITH {LINKS_SQL.strip()} SELECT rel_type, count(*) AS edges, sum(frequency)::BIGINT AS frequency, (SELECT count(*) FROM part) AS nodes FROM edges GROUP BY rel_type"),
    "sink_json": (json_sink, "SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_size AS size FROM part"),
    "classify_phased": (phased, PHASED_SQL),
    "filter_indexed": (indexed, "SELECT p_partkey AS id, p_type AS kind FROM part WHERE p_type IN ('STANDARD', 'SMALL', 'LARGE') OR (p_type = 'PROMO' AND p_size > 20) OR p_brand IN ('Brand#7', 'Brand#8') OR p_retailprice % 30 > 10"),
    "calibration_dashboard": (calibration_dashboard, f"WITH {SCORED}, x AS (SELECT count(*) FILTER (WHERE row_id % 3 = 0) AS pending, count(*) FILTER (WHERE row_id % 3 <> 0) AS completed, avg(cosine - score) FILTER (WHERE row_id % 3 <> 0) AS g FROM s) SELECT pending, completed, round(completed * 100.0::DOUBLE / (pending + completed), 6) AS progress, round(g, 6) AS average, CASE WHEN g > 0.4 THEN 'HIGH' WHEN g > 0.2 THEN 'MODERATE' ELSE 'LOW' END AS interpretation FROM x"),
}
