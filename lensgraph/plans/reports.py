"""Text, rule, consensus and quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lensgraph.functions import scores, texts
from lensgraph.operators import reports
from lensgraph.sources.tables import table


def prompts(spark, d):
    t = table(spark, d, "benchmark")
    lens = F.element_at(F.array(F.lit("find structure"), F.lit("find meaning"), F.lit(None)), (F.col("item_id") % 3 + 1).cast("int"))
    return t.select("item_id", F.md5(texts.instruct(F.col("text"), lens).cast("binary")).alias("instruct"), F.md5(texts.rerank_prompt(F.col("text"), F.lit("answer"), F.lit("judge")).cast("binary")).alias("rerank"))


def hashes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", texts.short_hash(t).alias("short"), texts.content_hash(t).alias("content"), texts.cache_key(t, F.col("lang"), 64).alias("cache"))


def token_estimates(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars")).select("source", scores.token_estimate(F.col("chars")).alias("tokens"), F.round(scores.embed_cost(F.col("chars"), 0.25, 0.02), 6).alias("cost"))


#: Endings of made-up class names, with the node type and the priority that they should give.
ENDINGS = [("Controller", "CONTROLLER", 1), ("ServiceImpl", "SERVICE", 2), ("Repo.java", "REPOSITORY", 3), ("Configuration", "CONFIG", 5), ("Entity.java", "ENTITY", 4), ("Tests", "TEST", 5), ("Helper", "UTIL", 5), ("SecurityFilter", "SECURITY", 5), ("SecurityConfig", "CONFIG", 5), ("Response.java", "DTO", 5), ("Bean", "ENTITY", 4)]


def node_types(spark, d):
    """Names made of a word and an ending by size; the last ending has @Entity in its content."""
    k = F.col("p_size") % len(ENDINGS)
    ending = F.element_at(F.array(*[F.lit(x) for x, _, _ in ENDINGS]), (k + 1).cast("int"))
    n = table(spark, d, "part").select(F.concat(F.initcap(F.substring_index("p_name", " ", 1)), ending).alias("name"), F.when(k == len(ENDINGS) - 1, "@Entity class").alias("content"))
    kind = texts.node_type(F.col("name"), F.col("content"))
    return n.select("name", kind.alias("kind"), texts.priority(kind).alias("priority")).groupBy("kind", "priority").agg(F.count("*").alias("files"), F.countDistinct("name").alias("names"))


NODE_TYPES_SQL = f"""WITH n AS (SELECT upper(substr(split_part(p_name, ' ', 1), 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) AS w, p_size % {len(ENDINGS)} + 1 AS k FROM part),
t AS (SELECT w || {[e[0] for e in ENDINGS]}[k] AS name, {[e[1] for e in ENDINGS]}[k] AS kind, {[e[2] for e in ENDINGS]}[k] AS priority FROM n)
SELECT kind, priority, count(*) AS files, count(DISTINCT name) AS names FROM t GROUP BY kind, priority"""


def classified_urls(spark, d):
    u = F.col("url")
    label, sure = texts.first_match([(u, r"\?.*page=", "LISTING", 0.95), (u, r"/(de|fr|es)/", "LOCALIZED", 0.9), (u, r"[0-9]+$", "ITEM", 0.85)])
    return table(spark, d, "pages").groupBy(F.coalesce(label, F.lit("OTHER")).alias("label"), F.coalesce(sure, F.lit(0.0)).alias("confidence")).agg(F.count("*").alias("pages"))


def domains(spark, d):
    package = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("com.shop."), F.lower("p_type"), F.lit(".model"))).when(F.col("p_size") % 3 == 1, F.concat(F.lower("p_type"), F.lit(".util"))).otherwise("single")
    return table(spark, d, "part").groupBy(texts.domain(package).alias("domain")).agg(F.count("*").alias("files"))


def basenames(spark, d):
    return table(spark, d, "pages").select("page_id", texts.basename(F.col("url")).alias("name"), F.size(F.split("html", "\n")).alias("lines"), F.length(F.substring("html", 1, 1000)).alias("head"))


#: Code that is put behind each text, in turn.
CODE = ["@Transactional try { repo.save(x) } catch (E e) try{ y }", "enum Status @Async @Retryable", "enum async retry http save(x)", "WebClient CompletableFuture repo.delete(x) catch (E e)"]


def behaviors(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c in CODE]), (F.col("doc_id") % 4 + 1).cast("int"))
    t = F.concat(F.col("text"), F.lit("\n"), code)
    return table(spark, d, "documents").groupBy(texts.behavioral_context(F.col("source"), t).alias("behavior")).agg(F.count("*").alias("docs"))


BEHAVIOR_SQL = f"""WITH t AS (SELECT source, text || chr(10) || {CODE}[doc_id % 4 + 1] AS t FROM documents),
c AS (SELECT *, len(regexp_extract_all(t, 'try ?\\{{')) AS tries, len(regexp_extract_all(t, 'catch ?\\(')) AS catches FROM t),
b AS (SELECT 'Runtime Analysis for ' || source || ':' || chr(10) || concat_ws(chr(10),
  CASE WHEN contains(t, '@Transactional') THEN '- Transaction boundary: @Transactional present' END, CASE WHEN contains(t, 'enum') AND contains(t, 'Status') THEN '- State machine: Status enum detected' END,
  CASE WHEN tries > 0 THEN '- Error handling: ' || tries || ' try blocks, ' || catches || ' catch blocks' END, CASE WHEN contains(t, '@Async') OR contains(t, 'CompletableFuture') THEN '- Async: Asynchronous execution present' END,
  CASE WHEN contains(t, '@Retry') THEN '- Retry: Retry logic configured' END, CASE WHEN contains(t, '.save(') OR contains(t, '.delete(') THEN '- Side effects: Database write operations' END,
  CASE WHEN contains(t, 'RestTemplate') OR contains(t, 'WebClient') THEN '- Side effects: External HTTP calls' END) AS behavior FROM c)
SELECT behavior, count(*) AS docs FROM b GROUP BY behavior"""


def structural_texts(spark, d):
    """Parts as nodes, their lines as hyperedges by flag and ship status."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("sources"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("targets"), F.collect_set("l_returnflag").alias("types"))
    p = table(spark, d, "part").join(lines, F.col("p_partkey") == F.col("id"))
    node = {"name": F.col("p_name"), "node_type": F.col("p_type"), "entity_type": F.col("p_brand"), "in_degree": F.col("p_size"), "out_degree": F.col("targets"), "betweenness": F.col("p_size") / 100, "pagerank": F.col("p_size") / 1000, "community": F.col("p_partkey") % 10}
    return p.select("id", texts.structural_context(node, F.col("sources"), F.col("targets"), F.col("types")).alias("context"))


STRUCTURAL_SQL = """WITH l AS (SELECT l_partkey AS id, count(*) FILTER (l_linestatus = 'O') AS s, count(*) FILTER (l_linestatus = 'F') AS t, list_sort(list(DISTINCT l_returnflag)) AS types FROM lineitem GROUP BY 1)
SELECT id, concat_ws(chr(10), 'Node: ' || p_name, 'Node Type: ' || p_type, 'Entity Type: ' || p_brand, chr(10) || 'Graph Properties:', '- In-Degree: ' || p_size, '- Out-Degree: ' || t, '- Betweenness Centrality: ' || format('{:.4f}', p_size / 100.0::DOUBLE),
'- PageRank: ' || format('{:.6f}', p_size / 1000.0::DOUBLE), '- Community: ' || p_partkey % 10, chr(10) || 'Hyperedge Participation:', '- As Source: ' || s || ' hyperedges', '- As Target: ' || t || ' hyperedges',
'- Types: [' || array_to_string(list_transform(types, lambda x: chr(39) || x || chr(39)), ', ') || ']') AS context FROM part JOIN l ON id = p_partkey"""


def surest_rules(spark, d):
    """Entity types of texts by rules that overlap: the most confident counts. Then the text to embed."""
    t = F.col("text")
    rules = [(t.contains("th"), "FILE_REGISTRY", 0.97), (t.contains("sch"), "STATE_MACHINE", 0.99), (t.contains("ción"), "CONFIG_STATE", 0.98), (t.contains("eau"), "SECURITY_LAYER", 0.99), (t.contains("en"), "TEMPORAL_CONTEXT", 0.96)]
    best = texts.surest(rules)
    entity = F.coalesce(best["label"], F.lit("OTHER"))
    return table(spark, d, "documents").select("doc_id", entity.alias("entity"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"), texts.entity_text(F.col("source"), entity).alias("keywords"))


SUREST_SQL = """WITH r AS (SELECT doc_id, source, CASE WHEN contains(text, 'sch') THEN 'STATE_MACHINE' WHEN contains(text, 'eau') THEN 'SECURITY_LAYER' WHEN contains(text, 'ción') THEN 'CONFIG_STATE' WHEN contains(text, 'th') THEN 'FILE_REGISTRY' WHEN contains(text, 'en') THEN 'TEMPORAL_CONTEXT' ELSE 'OTHER' END AS entity FROM documents),
w AS (SELECT * FROM (VALUES ('STATE_MACHINE', 0.99, 'controller endpoint api rest'), ('SECURITY_LAYER', 0.99, 'security authentication authorization'), ('CONFIG_STATE', 0.98, 'configuration settings properties'), ('FILE_REGISTRY', 0.97, 'service repository business logic'), ('TEMPORAL_CONTEXT', 0.96, 'schedule timer async cron'), ('OTHER', 0.0, '')) v(entity, confidence, words))
SELECT doc_id, entity, confidence::DOUBLE AS confidence, source || ' ' || entity || ' ' || words AS keywords FROM r JOIN w USING (entity)"""


def contexts(spark, d):
    c = table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return g.select("conv_id", texts.context(F.concat_ws(",", F.transform("t", lambda x: x["role"])), F.when(F.size("t") > 5, "long")).alias("context"))


def confidence_fold(spark, d):
    """scores.bayes_fold() of each user's events in order, as a sum: an outcome counts 3^-rank, ranked from the last."""
    w = Window.partitionBy("user_id").orderBy(F.desc("at"))
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", (F.col("event_type") != "error").alias("ok")).alias("at"))
    e = e.select("user_id", F.col("at.ok").alias("ok"), F.row_number().over(w).alias("r"))
    g = e.groupBy("user_id").agg(F.max("r").alias("n"), F.sum(F.when(F.col("ok"), F.pow(F.lit(3.0), -F.col("r"))).otherwise(0.0)).alias("s"))
    return g.select("user_id", F.round(F.col("s") + 0.5 * F.pow(F.lit(3.0), -F.col("n")), 6).alias("confidence"))


def pattern_library(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "purchase").alias("ok"), "event_id")
    out = reports.pattern_library(e, "user_id", "at", "ok", "event_id")
    return out.select("user_id", "uses", "successes", F.round("confidence", 6).alias("confidence"), F.size("examples").alias("examples"))


def pattern_match(spark, d):
    """Patterns against events: mean of the similarities there are, kept above .7, ranked by similarity times confidence."""
    p = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.avg(F.get_json_object("props", "$.k").cast("double")).alias("k"))
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("double").alias("ek"))
    # without the same type at most two of three parts, or one of two, are there: never above .7, so only equal types meet
    j = e.join(p, F.col("kind") == F.col("event_type"))
    a, b = 1 / (1 + F.abs(F.col("value") - F.col("v")) / 10), F.when(F.col("ek") < 50, 1 / (1 + F.abs(F.col("ek") - F.col("k")) / 100))
    c = F.lit(1.0)
    sim = (a + F.coalesce(b, F.lit(0.0)) + c) / (2 + F.when(b.isNotNull(), 1).otherwise(0))
    return j.select("event_type", sim.alias("s")).filter("s > 0.7").groupBy("event_type").agg(F.count("*").alias("matches"), F.round(F.avg("s"), 6).alias("similarity"))


def history(spark, d):
    out = reports.last_rows(table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at")), "user_id", "at", 10)
    return out.select("user_id", "event_id", "recency")


def majority(spark, d):
    v = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_discount")
    out = reports.majority(v, "l_partkey", "l_returnflag", "l_discount")
    return out.select("l_partkey", "l_returnflag", "votes", "total", F.round("confidence", 6).alias("confidence"))


def consensus(spark, d):
    """The first five lines of each part as five judges: how they split."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    v = table(spark, d, "lineitem").withColumn("judge", F.row_number().over(w)).filter("judge <= 5")
    g = v.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy("l_partkey").agg(F.sort_array(F.collect_list("n"), asc=False).alias("s"))
    return g.groupBy(scores.consensus_pattern(F.col("s")).alias("pattern")).agg(F.count("*").alias("topics"), F.round(F.avg(F.get("s", F.lit(0)) / 5), 6).alias("score"))


def overlaps(spark, d):
    out = reports.overlap(table(spark, d, "lineitem").filter("l_discount >= 0.09"), "l_returnflag", "l_partkey")
    return out.select("shared", "any", F.round("overlap", 6).alias("overlap"))


def profiles(spark, d):
    out = reports.profile(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])
    return out.select("column", "n", "missing", *[F.round(c, 4).alias(c) for c in ("mean", "deviation", "sample_deviation", "q1", "median", "q3")], "outliers")


PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS deviation, round(stddev_samp({c}), 4) AS sample_deviation, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3, (SELECT sum((abs({c} - m) > 3 * s)::INT)::BIGINT FROM orders, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM orders)) AS outliers FROM orders" for c in ("o_totalprice", "o_custkey"))


def correlations(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"))


def missing(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.get_json_object("props", "$.k").cast("int") >= 20, F.col("value")).alias("v"))
    return e.groupBy("event_type").agg(F.round(1 - F.count("v") / F.count("*"), 6).alias("share")).withColumn("policy", reports.missing_policy(F.col("share")))


def rfm(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    until = F.lit("1998-12-31").cast("timestamp")
    recent = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")
    return o.groupBy("c_custkey").agg(F.datediff(until, F.max("o_orderdate")).alias("recency"), F.sum(recent.cast("long")).alias("frequency"), F.round(F.sum(F.when(recent, F.col("o_totalprice")).otherwise(0.0)), 2).alias("monetary"))


def repeat_runs(spark, d):
    """Each kind of event is a test with its runs: mean, deviation, and the mean deviation of all tests as consistency."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    e = e.join(F.broadcast(e.agg(F.avg("s").alias("c"))))  # one row
    return e.select("event_type", F.round("m", 6).alias("mean"), F.round("s", 6).alias("deviation"), (F.col("m") >= 50).alias("passed"), F.round("c", 6).alias("mean_consistency"))


def ab(spark, d):
    out = reports.ab_test(table(spark, d, "events"), "event_type", "click", "view", "value")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "improvement", "t", "p")], "significant")


AB_SQL = "WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), x AS (SELECT * FROM s WHERE event_type = 'click'), y AS (SELECT * FROM s WHERE event_type = 'view') SELECT round(x.m, 6) AS mean_a, round(y.m, 6) AS mean_b, round((y.m - x.m) / x.m, 6) AS improvement, round((y.m - x.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2) * (1.0 / x.n + 1.0 / y.n)), 6) AS t FROM x, y"


def ab_without_p(spark, d):
    return ab(spark, d).drop("p", "significant")


def quality(spark, d):
    o = table(spark, d, "orders")
    out = reports.quality(o, F.col("o_totalprice").isNotNull() & F.col("o_orderdate").isNotNull(), F.col("o_orderstatus").isin("P", "O", "F"), F.col("o_totalprice").between(1000, 400000), "o_orderkey")
    return out.select(*[F.round(c, 6).alias(c) for c in ("completeness", "consistency", "accuracy", "uniqueness", "quality")], "passed")


def integrity(spark, d):
    """Graph-wide checks: hubs, orphans, kinds of relation, vectors that are missing."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    orphans = n.join(r, n.n_regionkey == r.r_regionkey, "left_anti").agg(F.count("*"))
    kinds = table(spark, d, "lineitem").agg(F.countDistinct("l_returnflag"))
    empty = table(spark, d, "embeddings").filter("embedding is null or size(embedding) = 0").agg(F.count("*"))
    per = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*"))
    return reports.checks(spark, [("hubs", r.agg(F.count("*")), 1, ">="), ("orphans", orphans, 0, "="), ("relation types", kinds, 3, ">="), ("missing embeddings", empty, 0, "="), ("hyperedges without nodes", per, 0, "=")])


def class_scores(spark, d):
    """Weighted artifact scores summed by class; the highest class."""
    p = table(spark, d, "part").select((F.col("p_size") % 4).alias("color"), sum((F.col(c) / m * w for (c, m), w in zip((("p_size", 50), ("p_retailprice", 2000), ("p_size", 100), ("p_retailprice", 4000)), scores.ARTIFACT_WEIGHTS, strict=True)), F.lit(0.0)).alias("score"))
    return p.groupBy("color").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "color").limit(1).select("color", F.round("score", 4).alias("score"))


def majority_table(spark, d):
    return spark.createDataFrame([(n, p, round(scores.majority_correct(n, p), 6)) for n in (1, 3, 5, 7) for p in (0.5, 0.6, 0.7, 0.9)], "n int, p double, chance double")


MAJORITY_SQL = "WITH g AS (SELECT n, p FROM (VALUES (1), (3), (5), (7)) a(n), (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) b(p)), k AS (SELECT n, p, unnest(range((n + 1) // 2, n + 1)) AS k FROM g) SELECT n, p, round(sum(gamma(n + 1.0) / gamma(k + 1.0) / gamma(n - k + 1.0) * pow(p, k) * pow(1 - p, n - k)), 6) AS chance FROM k GROUP BY n, p"


def drift_trend(spark, d):
    """Daily mean quality against the day before."""
    day = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    before = F.lag("m").over(Window.orderBy("day"))  # one row a day
    return day.withColumn("before", before).select("day", F.round("m", 6).alias("quality"), F.round(F.col("m") - F.col("before"), 6).alias("change"))


def json_round_trip(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"), F.to_json(F.struct("event_type", "user_id")).alias("j"))
    return e.select("event_id", F.col("p.k").alias("k"), F.get_json_object("j", "$.user_id").cast("long").alias("user_id"))


def routing(spark, d):
    """Quality encoder for critical kinds or high importance, else the fast one."""
    p = table(spark, d, "part")
    return p.groupBy(F.when(F.col("p_type").isin("PROMO", "LARGE") | (F.col("p_size") / 50 > 0.8), "quality").otherwise("fast").alias("encoder")).agg(F.count("*").alias("files"))


def selective(spark, d):
    p = table(spark, d, "part")
    cond = F.col("p_size").between(40, 50) | F.col("p_name").contains("red") | F.col("p_brand").startswith("Brand#1") | F.col("p_type").isin("PROMO")
    return p.filter(cond).groupBy("p_type").agg(F.count("*").alias("files"))


def entity_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("files"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"), F.countDistinct("c_nationkey").alias("domains"))


def buggy(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("bug_frequency"))
    return e.filter("bug_frequency > 0.1")


def unwound(spark, d):
    w = F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word")
    return table(spark, d, "benchmark").select("item_id", w).filter("word <> ''").groupBy("word").agg(F.count("*").alias("items")).filter("items > 1")


def weighted_consensus(spark, d):
    """Weights .4, .35, .25 over three scores."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(F.lit(0.4) * F.col("p_size") / 50 + F.lit(0.35) * F.col("p_retailprice") / 2000 + F.lit(0.25) * (F.col("p_partkey") % 10) / 10, 8).alias("score"))


QUERIES = {
    "text_prompts": (prompts, "WITH t AS (SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN 'find structure' WHEN 1 THEN 'find meaning' END AS i FROM benchmark) SELECT item_id, md5(CASE WHEN i IS NULL THEN text ELSE 'Instruct: ' || i || chr(10) || 'Query: ' || text END) AS instruct, md5('<Instruct>: judge' || chr(10) || '<Query>: ' || text || chr(10) || '<Document>: answer') AS rerank FROM t"),
    "text_hashes": (hashes, "SELECT doc_id, substr(sha256(text), 1, 8) AS short, sha256(text) AS content, md5(text) || ':' || lang || ':64' AS cache FROM documents"),
    "text_token_estimate": (token_estimates, "SELECT source, greatest(1, floor(sum(length(text)) / 4.0))::BIGINT AS tokens, round(sum(length(text)) * 0.25::DOUBLE / 1000 * 0.02::DOUBLE, 6) AS cost FROM documents GROUP BY source"),
    "text_node_types": (node_types, NODE_TYPES_SQL),
    "text_structural_context": (structural_texts, STRUCTURAL_SQL),
    "text_surest_rule": (surest_rules, SUREST_SQL),
    "text_classify": (classified_urls, "SELECT CASE WHEN regexp_matches(url, '\\?.*page=') THEN 'LISTING' WHEN regexp_matches(url, '/(de|fr|es)/') THEN 'LOCALIZED' WHEN regexp_matches(url, '[0-9]+$') THEN 'ITEM' ELSE 'OTHER' END AS label, CASE WHEN regexp_matches(url, '\\?.*page=') THEN 0.95 WHEN regexp_matches(url, '/(de|fr|es)/') THEN 0.9 WHEN regexp_matches(url, '[0-9]+$') THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence, count(*) AS pages FROM pages GROUP BY 1, 2"),
    "text_domains": (domains, "SELECT CASE p_size % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_type) ELSE 'core' END AS domain, count(*) AS files FROM part GROUP BY 1"),
    "text_basenames": (basenames, "SELECT page_id, regexp_extract(url, '[^/]*$') AS name, len(string_split(html, chr(10)))::INT AS lines, length(substr(html, 1, 1000))::INT AS head FROM pages"),
    "text_behavior": (behaviors, BEHAVIOR_SQL),
    "text_context": (contexts, "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) || CASE WHEN count(*) > 5 THEN chr(10) || chr(10) || 'long' ELSE '' END AS context FROM conversations GROUP BY conv_id"),
    "confidence_fold": (confidence_fold, "WITH e AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, round(sum(CASE WHEN ok THEN pow(3.0::DOUBLE, -r) ELSE 0 END) + 0.5::DOUBLE * pow(3.0::DOUBLE, -max(r)), 6) AS confidence FROM e GROUP BY user_id"),
    "pattern_library": (pattern_library, "WITH e AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), g AS (SELECT user_id, max(r) FILTER (WHERE ok) AS uses, count(*) FILTER (WHERE ok) AS successes, sum(pow(3.0::DOUBLE, -r)) FILTER (WHERE ok) AS s FROM e GROUP BY user_id) SELECT user_id, uses::INT AS uses, successes::INT AS successes, round(s + 0.8::DOUBLE * pow(3.0::DOUBLE, -uses), 6) AS confidence, least(uses, 10)::INT AS examples FROM g WHERE uses IS NOT NULL"),
    "pattern_match": (pattern_match, "WITH e AS (SELECT event_id, event_type AS kind, value, json_extract(props, '$.k')::DOUBLE AS ek FROM events), p AS (SELECT event_type, avg(value) AS v, avg(json_extract(props, '$.k')::DOUBLE) AS k FROM events GROUP BY 1), s AS (SELECT p.event_type, 1 / (1 + abs(value - v) / 10) AS a, CASE WHEN ek < 50 THEN 1 / (1 + abs(ek - k) / 100) END AS b, CASE WHEN kind = p.event_type THEN 1.0::DOUBLE ELSE 0 END AS c FROM e, p), m AS (SELECT event_type, (a + coalesce(b, 0) + c) / (2 + (b IS NOT NULL)::INT) AS s FROM s) SELECT event_type, count(*) AS matches, round(avg(s), 6) AS similarity FROM m WHERE s > 0.7 GROUP BY event_type"),
    "session_history": (history, "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS recency FROM events) SELECT * FROM r WHERE recency <= 10"),
    "consensus_majority": (majority, "WITH n AS (SELECT l_partkey, l_returnflag, count(*) AS votes, sum(l_discount) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(votes) OVER (PARTITION BY l_partkey)::BIGINT AS total, sum(s) OVER (PARTITION BY l_partkey) AS t, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_returnflag) AS rn FROM n) SELECT l_partkey, l_returnflag, votes, total, round(t / total, 6) AS confidence FROM r WHERE rn = 1"),
    "consensus_patterns": (consensus, "WITH v AS (SELECT l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS j FROM lineitem), n AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM v WHERE j <= 5 GROUP BY 1, 2), p AS (SELECT l_partkey, string_agg(n::VARCHAR, '-' ORDER BY n DESC) AS pattern, max(n) AS top FROM n GROUP BY 1) SELECT pattern, count(*) AS topics, round(avg(top / 5.0::DOUBLE), 6) AS score FROM p GROUP BY pattern"),
    "consensus_overlap": (overlaps, "WITH p AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS k FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1) SELECT sum((k = (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_discount >= 0.09))::INT)::BIGINT AS shared, count(*) AS \"any\", round(sum((k = 3)::INT) / count(*)::DOUBLE, 6) AS overlap FROM p"),
    "profile_columns": (profiles, PROFILE_SQL),
    "profile_correlation": (correlations, "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY 1"),
    "profile_missing_policy": (missing, "WITH e AS (SELECT event_type, CASE WHEN json_extract(props, '$.k')::INT >= 20 THEN value END AS v FROM events), s AS (SELECT event_type, round(1 - count(v) / count(*)::DOUBLE, 6) AS share FROM e GROUP BY 1) SELECT *, CASE WHEN share < 0.05 THEN 'DROP_ROWS' WHEN share < 0.3 THEN 'IMPUTE' ELSE 'DROP_COLUMN' END AS policy FROM s"),
    "profile_rfm": (rfm, "SELECT o_custkey AS c_custkey, date_diff('day', max(o_orderdate)::DATE, DATE '1998-12-31')::INT AS recency, sum((o_orderdate >= '1998-01-01')::INT)::BIGINT AS frequency, round(sum(CASE WHEN o_orderdate >= '1998-01-01' THEN o_totalprice ELSE 0 END), 2) AS monetary FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"),
    "quality_repeat_runs": (repeat_runs, "WITH t AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_type, round(m, 6) AS mean, round(s, 6) AS deviation, m >= 50 AS passed, (SELECT round(avg(s), 6) FROM t) AS mean_consistency FROM t"),
    "quality_ab_test": (ab_without_p, AB_SQL),
    "quality_ab_significance": (ab, None),
    "quality_dimensions": (quality, "WITH q AS (SELECT avg((o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL)::INT) AS a, avg((o_orderstatus IN ('P', 'O', 'F'))::INT) AS b, avg((o_totalprice BETWEEN 1000 AND 400000)::INT) AS c, count(DISTINCT o_orderkey) / count(*)::DOUBLE AS d FROM orders) SELECT round(a, 6) AS completeness, round(b, 6) AS consistency, round(c, 6) AS accuracy, round(d, 6) AS uniqueness, round((a + b + c + d) / 4, 6) AS quality, (a + b + c + d) / 4 >= 0.8 AS passed FROM q"),
    "quality_integrity": (integrity, "SELECT 'hubs' AS \"check\", count(*)::DOUBLE AS value, 1.0::DOUBLE AS target, count(*) >= 1 AS passed FROM region UNION ALL SELECT 'orphans', count(*)::DOUBLE, 0, count(*) = 0 FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'relation types', count(DISTINCT l_returnflag)::DOUBLE, 3, count(DISTINCT l_returnflag) >= 3 FROM lineitem UNION ALL SELECT 'missing embeddings', count(*)::DOUBLE, 0, count(*) = 0 FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0 UNION ALL SELECT 'hyperedges without nodes', count(*)::DOUBLE, 0, count(*) = 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "artifact_class_scores": (class_scores, "WITH s AS (SELECT p_size % 4 AS color, sum(p_size / 50.0::DOUBLE * 0.3 + p_retailprice / 2000 * 0.3 + p_size / 100.0::DOUBLE * 0.2 + p_retailprice / 4000 * 0.2) AS score FROM part GROUP BY 1) SELECT color, round(score, 4) AS score FROM s ORDER BY s.score DESC, color LIMIT 1"),
    "consensus_majority_chance": (majority_table, MAJORITY_SQL),
    "quality_drift": (drift_trend, "WITH d AS (SELECT ts::DATE AS day, avg(value) AS m FROM events GROUP BY 1) SELECT day, round(m, 6) AS quality, round(m - lag(m) OVER (ORDER BY day), 6) AS change FROM d"),
    "json_round_trip": (json_round_trip, "SELECT event_id, json_extract(props, '$.k')::INT AS k, user_id FROM events"),
    "encoder_routing": (routing, "SELECT CASE WHEN p_type IN ('PROMO', 'LARGE') OR p_size / 50.0 > 0.8 THEN 'quality' ELSE 'fast' END AS encoder, count(*) AS files FROM part GROUP BY 1"),
    "filter_selective": (selective, "SELECT p_type, count(*) AS files FROM part WHERE p_size BETWEEN 40 AND 50 OR contains(p_name, 'red') OR starts_with(p_brand, 'Brand#1') OR p_type = 'PROMO' GROUP BY 1"),
    "aggregate_entities": (entity_counts, "SELECT c_mktsegment, count(*) AS files, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most, count(DISTINCT c_nationkey) AS domains FROM customer GROUP BY 1"),
    "filter_buggy": (buggy, "WITH e AS (SELECT user_id, round(avg((event_type = 'error')::INT), 6) AS bug_frequency FROM events GROUP BY 1) SELECT * FROM e WHERE bug_frequency > 0.1"),
    "unwind_words": (unwound, "WITH w AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM benchmark) SELECT word, count(*) AS items FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) > 1"),
    "consensus_weighted": (weighted_consensus, "SELECT p_partkey, round(0.4::DOUBLE * p_size / 50 + 0.35::DOUBLE * p_retailprice / 2000 + 0.25::DOUBLE * (p_partkey % 10) / 10, 8) AS score FROM part"),
}
