"""Graph queries over the parts of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lensgraph.operators import communities as louvain_communities
from lensgraph.operators import csr, graph, messages, ranks, strong
from lensgraph.operators.components import connected_components
from lensgraph.sources.tables import LINKS_SQL, edges, hierarchy, links, nodes, table
from lensgraph.shared import written

WITH = f"WITH {LINKS_SQL.strip()}"
REC = f"WITH RECURSIVE {LINKS_SQL.strip()}"
CALLS = "SELECT DISTINCT src, dst FROM edges WHERE rel_type = 'CALLS'"


def calls(spark, d):
    return written(edges(spark, d).filter("rel_type = 'CALLS'"), "calls")


def starts(spark, d):
    """The stated set of start nodes: ids divisible by 100."""
    return nodes(spark, d).filter("id % 100 = 0").select("id")


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def one_hop(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    a, b = n.select(F.col("id").alias("src"), F.col("name").alias("src_name")), n.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    return e.filter("rel_type = 'CALLS'").join(a, "src").join(b, "dst").groupBy("src_name", "dst_kind").agg(F.count("*").alias("calls"))


def dependents(spark, d):
    e = edges(spark, d).filter(F.col("rel_type").isin("CALLS", "DEPENDS_ON"))
    return e.groupBy("dst").agg(F.countDistinct("src").alias("dependents"), F.max("frequency").alias("most")).filter("dependents >= 5").withColumnRenamed("dst", "id")


def undirected_pairs(spark, d):
    e = edges(spark, d)
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy("a").agg(F.count("*").alias("neighbours"))


def chained(spark, d):
    e = edges(spark, d)
    x = e.filter("rel_type = 'CALLS' and frequency > 1").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    y = e.filter("rel_type = 'IMPORTS'").select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return x.join(y, "b").groupBy("a", "b").agg(F.sort_array(F.collect_set("c")).alias("found")).select("a", "b", F.size("found").alias("reached"), F.element_at("found", 1).alias("first"))


def isolated(spark, d):
    used = edges(spark, d).filter("frequency > 1").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes(spark, d).join(used, "id", "left_anti").groupBy("kind").agg(F.count("*").alias("orphans"))


def exists_pattern(spark, d):
    e = edges(spark, d).filter("rel_type = 'DEPENDS_ON' and weight > 45").select(F.col("src").alias("id"))
    return nodes(spark, d).join(e, "id", "left_semi").select("id", "name")


def degree(spark, d):
    return graph.degrees(nodes(spark, d), edges(spark, d).filter("rel_type = 'CALLS'"))


def god_classes(spark, d):
    return graph.degrees(nodes(spark, d), edges(spark, d)).select("id", (F.col("out_degree") + F.col("in_degree")).alias("degree")).filter("degree > 30")


def pagerank(spark, d):
    return _round(messages.pagerank(nodes(spark, d), calls(spark, d).select("src", "dst"), rounds=6), "rank", digits=8)


def pagerank_sql(rounds=6, damping=0.85):
    steps = [f"{WITH}, calls AS ({CALLS}), outs AS (SELECT src, count(*) AS n FROM calls GROUP BY src), size AS (SELECT count(*)::DOUBLE AS n FROM part), r0 AS (SELECT p_partkey AS id, 1.0::DOUBLE / size.n AS rank FROM part, size)"]
    for k in range(rounds):
        steps.append(f"lost{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM outs)), got{k} AS (SELECT c.dst AS id, sum(r.rank / o.n) AS got FROM calls c JOIN outs o ON c.src = o.src JOIN r{k} r ON r.id = c.src GROUP BY c.dst), r{k + 1} AS (SELECT r.id, (1 - {damping}::DOUBLE) / size.n + {damping}::DOUBLE * (coalesce(g.got, 0) + lost / size.n) AS rank FROM r{k} r LEFT JOIN got{k} g ON g.id = r.id, lost{k}, size)")
    return ", ".join(steps) + f" SELECT id, round(rank, 8) AS rank FROM r{rounds}"


def eigenvector(spark, d):
    """Until it moves no more than the operator's tolerance."""
    return _round(graph.power_iteration(calls(spark, d).select("src", "dst", "weight"), rounds=100), "value")


def message_centrality(spark, d):
    return _round(messages.centrality(nodes(spark, d), calls(spark, d).select("src", "dst", "weight"), 4), "value", digits=8)


def message_centrality_sql(rounds=4):
    steps = [f"{WITH}, calls AS (SELECT src, dst, weight FROM edges WHERE rel_type = 'CALLS'), v0 AS (SELECT p_partkey AS id, 1.0::DOUBLE AS value FROM part)"]
    for k in range(rounds):
        steps.append(f"n{k} AS (SELECT sqrt(sum(value * value)) AS norm FROM v{k}), v{k + 1} AS (SELECT p_partkey AS id, coalesce(sum(v.value * c.weight), 0) / any_value(norm) AS value FROM part CROSS JOIN n{k} LEFT JOIN calls c ON c.dst = p_partkey LEFT JOIN v{k} v ON v.id = c.src GROUP BY p_partkey)")
    return ", ".join(steps) + f" SELECT id, round(value / (SELECT sqrt(sum(value * value)) FROM v{rounds}), 8) AS value FROM v{rounds}"


def message_labels(spark, d):
    return messages.least_labels(nodes(spark, d), calls(spark, d).select("src", "dst"))


MESSAGE_LABELS_SQL = f"""{REC}, calls AS ({CALLS}), walk(id, label) USING KEY (id) AS (
  SELECT p_partkey, p_partkey FROM part
  UNION SELECT c.dst, min(w.label) FROM walk w JOIN calls c ON c.src = w.id JOIN recurring.walk r ON r.id = c.dst WHERE w.label < r.label GROUP BY c.dst
) SELECT id, label FROM walk"""


def message_distances(spark, d):
    """Least sum of quantities from any of the start nodes."""
    e = calls(spark, d).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    return _round(messages.distances(nodes(spark, d), e, F.col("id") % 100 == 0), "distance")


MESSAGE_DISTANCES_SQL = f"""{REC}, calls AS (SELECT src, dst, weight::DOUBLE AS weight FROM edges WHERE rel_type = 'CALLS'), walk(id, distance) USING KEY (id) AS (
  SELECT p_partkey, CASE WHEN p_partkey % 100 = 0 THEN 0.0::DOUBLE ELSE 1e300::DOUBLE END FROM part
  UNION SELECT c.dst, min(w.distance + c.weight) FROM walk w JOIN calls c ON c.src = w.id JOIN recurring.walk r ON r.id = c.dst WHERE w.distance + c.weight < r.distance GROUP BY c.dst
) SELECT id, round(CASE WHEN distance < 1e300 THEN distance END, 6) AS distance FROM walk"""


def strong_components(spark, d):
    """Of the calls: on a cycle of any length or not, and with whom."""
    return strong.strong_components(nodes(spark, d), calls(spark, d))


STRONG_SQL = f"""{REC}, calls AS ({CALLS}), reach AS (SELECT src, dst FROM calls UNION SELECT r.src, c.dst FROM reach r JOIN calls c ON c.src = r.dst),
mutual AS (SELECT f.src AS id, min(f.dst) AS first FROM reach f JOIN reach b ON b.src = f.dst AND b.dst = f.src GROUP BY f.src)
SELECT p_partkey AS id, coalesce(first, p_partkey) AS component, first IS NOT NULL AS cyclic FROM part LEFT JOIN mutual ON id = p_partkey"""


def louvain(spark, d):
    """A pair weighs as many links as it has, so links are added at once, not by type first."""
    return louvain_communities.louvain(links(spark, d).select("src", "dst", F.lit(1).alias("weight")))


def erdos(spark, d):
    return graph.hops(calls(spark, d), starts(spark, d), 3, directed=False).groupBy("source", "hops").agg(F.count("*").alias("nodes"))


ERDOS_SQL = f"""{REC}, calls AS ({CALLS}), both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), walk AS (
  SELECT p_partkey AS source, p_partkey AS id, 0 AS hops FROM part WHERE p_partkey % 100 = 0
  UNION SELECT w.source, b.dst, w.hops + 1 FROM walk w JOIN both_ways b ON b.src = w.id WHERE w.hops < 3
), first AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY source, id)
SELECT source, hops, count(*) AS nodes FROM first GROUP BY source, hops"""


def shortest(spark, d):
    found = graph.shortest_paths(calls(spark, d), starts(spark, d), 3)
    return found.select("source", "id", "hops", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("path"))


def shortest_sql(most=3):
    parts = [f"{WITH}, calls AS ({CALLS}), f0 AS (SELECT p_partkey AS source, p_partkey AS id, 0 AS hops, [p_partkey] AS nodes FROM part WHERE p_partkey % 100 = 0), s0 AS (SELECT * FROM f0)"]
    for k in range(1, most + 1):
        parts.append(f"f{k} AS (SELECT source, c.dst AS id, {k} AS hops, min(list_append(nodes, c.dst)) AS nodes FROM f{k - 1} f JOIN calls c ON c.src = f.id WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.source = f.source AND s.id = c.dst) GROUP BY source, c.dst), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM f{k})")
    return ", ".join(parts) + f" SELECT source, id, hops, array_to_string(nodes, '>') AS path FROM s{most}"


def context(spark, d):
    return graph.context(calls(spark, d), starts(spark, d), 3, 50)


CONTEXT_SQL = f"""{REC}, calls AS ({CALLS}), both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), walk AS (
  SELECT p_partkey AS source, p_partkey AS id, 0 AS hops FROM part WHERE p_partkey % 100 = 0
  UNION SELECT w.source, b.dst, w.hops + 1 FROM walk w JOIN both_ways b ON b.src = w.id WHERE w.hops < 3
), first AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY source, id)
SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY source ORDER BY hops, id) <= 50"""


def exceptions(spark, d):
    e = edges(spark, d)
    found = graph.linked(calls(spark, d), starts(spark, d), 2, e.filter("rel_type = 'IMPORTS'"))
    return found.groupBy("source", "found").agg(F.count("*").alias("through"))


EXCEPTIONS_SQL = f"""{REC}, calls AS ({CALLS}), both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), walk AS (
  SELECT p_partkey AS source, p_partkey AS id, 0 AS hops FROM part WHERE p_partkey % 100 = 0
  UNION SELECT w.source, b.dst, w.hops + 1 FROM walk w JOIN both_ways b ON b.src = w.id WHERE w.hops < 2
), near AS (SELECT DISTINCT source, id FROM walk WHERE id <> source)
SELECT source, e.dst AS found, count(*) AS through FROM near JOIN edges e ON e.src = near.id WHERE e.rel_type = 'IMPORTS' GROUP BY source, e.dst"""


def impact(spark, d):
    e = edges(spark, d).filter(F.col("rel_type").isin("CALLS", "DEPENDS_ON")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.hops(e, starts(spark, d), 2).filter("hops > 0").groupBy("source").agg(F.count("*").alias("affected"), F.sum(F.when(F.col("hops") == 1, 1).otherwise(0)).alias("direct"))


IMPACT_SQL = f"""{REC}, back AS (SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE rel_type IN ('CALLS', 'DEPENDS_ON')), walk AS (
  SELECT p_partkey AS source, p_partkey AS id, 0 AS hops FROM part WHERE p_partkey % 100 = 0
  UNION SELECT w.source, b.dst, w.hops + 1 FROM walk w JOIN back b ON b.src = w.id WHERE w.hops < 2
), first AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY source, id)
SELECT source, count(*) AS affected, sum(CASE WHEN hops = 1 THEN 1 ELSE 0 END)::BIGINT AS direct FROM first WHERE hops > 0 GROUP BY source"""


def action(spark, d):
    e = calls(spark, d).select("src", "dst", graph.action_weight(1 / F.col("frequency"), F.lit(0.0)).alias("weight"))
    return _round(graph.least_action(e, starts(spark, d), 3), "action").groupBy("source", "action").agg(F.count("*").alias("nodes"))


ACTION_SQL = f"""{REC}, calls AS (SELECT src, dst, 0.5::DOUBLE * (1.0::DOUBLE / frequency) * (1.0::DOUBLE / frequency) AS weight FROM edges WHERE rel_type = 'CALLS'), walk AS (
  SELECT p_partkey AS source, p_partkey AS id, 0 AS hops, 0.0::DOUBLE AS action FROM part WHERE p_partkey % 100 = 0
  UNION SELECT w.source, c.dst, w.hops + 1, w.action + c.weight FROM walk w JOIN calls c ON c.src = w.id WHERE w.hops < 3
), least AS (SELECT source, id, round(min(action), 6) AS action FROM walk GROUP BY source, id)
SELECT source, action, count(*) AS nodes FROM least GROUP BY source, action"""


def variable_paths(spark, d):
    e = calls(spark, d).select("src", "dst").withColumn("edge_id", F.col("src") * 1_000_000_000 + F.col("dst"))
    return graph.paths(e, starts(spark, d), 1, 2).groupBy("start", "length").agg(F.count("*").alias("paths"), F.countDistinct("end").alias("ends"))


PATHS_SQL = f"""{WITH}, calls AS ({CALLS}), found AS (
  SELECT a.src AS start, a.dst AS "end", 1 AS length FROM calls a WHERE a.src % 100 = 0
  UNION ALL SELECT a.src, b.dst, 2 FROM calls a JOIN calls b ON b.src = a.dst AND NOT (b.src = a.src AND b.dst = a.dst) WHERE a.src % 100 = 0
) SELECT start, length, count(*) AS paths, count(DISTINCT "end") AS ends FROM found GROUP BY start, length"""


def cycles(spark, d):
    """Cycles of 2 to 5 edges, each from its least node."""
    return graph.cycles(calls(spark, d), 5).select("length", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("path"))


def cycles_sql(most=5):
    steps = [f"{WITH}, calls AS ({CALLS}), w1 AS (SELECT src AS first, dst AS last, [src, dst] AS nodes FROM calls WHERE src < dst)"]
    for k in range(2, most):
        steps.append(f"w{k} AS (SELECT first, dst AS last, list_append(nodes, dst) AS nodes FROM w{k - 1} JOIN calls ON src = last WHERE dst > first AND NOT list_contains(nodes, dst))")
    ends = [f"SELECT {k + 1} AS length, array_to_string(nodes, '>') AS path FROM w{k} JOIN calls ON src = last AND dst = first" for k in range(1, most)]
    return ", ".join(steps) + " " + " UNION ALL ".join(ends)


def graph_shape(spark, d):
    return _round(graph.shape(edges(spark, d).filter("rel_type = 'CALLS'")), "density", "clustering")


SHAPE_SQL = f"""{WITH}, half AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE rel_type = 'CALLS'), ends AS (SELECT a AS id FROM half UNION ALL SELECT b FROM half), degree AS (SELECT id, count(*) AS d FROM ends GROUP BY id), sizes AS (SELECT count(*) AS n, sum(d * (d - 1) // 2) AS twos FROM degree),
tri AS (SELECT count(*) AS triangles FROM half x JOIN half y ON y.a = x.b JOIN half z ON z.a = x.a AND z.b = y.b)
SELECT n AS nodes, (SELECT count(*) FROM half) AS links, round(2.0::DOUBLE * (SELECT count(*) FROM half) / (n * (n - 1)), 6) AS density, triangles, round(3.0::DOUBLE * triangles / twos, 6) AS clustering FROM sizes, tri"""


def communities(spark, d):
    return graph.label_propagation(edges(spark, d), rounds=4)


def communities_sql(rounds=4):
    steps = [f"{WITH}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT DISTINCT src AS id, src AS label FROM both_ways)"]
    for k in range(rounds):
        steps.append(f"c{k} AS (SELECT b.src AS id, l.label, count(*) AS n FROM both_ways b JOIN l{k} l ON l.id = b.dst GROUP BY b.src, l.label), l{k + 1} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS rn FROM c{k}) WHERE rn = 1)")
    return ", ".join(steps) + f" SELECT id, label FROM l{rounds}"


def modularity(spark, d):
    labels = nodes(spark, d).select("id", F.col("kind").alias("label"))
    return _round(graph.modularity(edges(spark, d), labels), "modularity")


MODULARITY_SQL = f"""{WITH}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), m AS (SELECT count(*)::DOUBLE AS m2 FROM both_ways),
sums AS (SELECT a.p_type AS label, sum(CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0 END) AS inside, count(*) AS ends FROM both_ways e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst GROUP BY a.p_type)
SELECT round(sum(inside / m2 - (ends / m2) * (ends / m2)), 6) AS modularity FROM sums, m"""


def components(spark, d):
    return connected_components(edges(spark, d), "src", "dst")


WALK = f"""{REC}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk(node, component) USING KEY (node) AS (
  SELECT src, min(least(src, dst)) FROM both_ways GROUP BY src
  UNION SELECT b.dst, min(w.component) FROM walk w JOIN both_ways b ON b.src = w.node JOIN recurring.walk r ON r.node = b.dst WHERE w.component < r.component GROUP BY b.dst
)"""


def cycle_rank(spark, d):
    """First Betti number of the undirected graph: links - nodes + components."""
    e = written(edges(spark, d), "all")
    parts = connected_components(e, "src", "dst").agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    links = graph.undirected(e).filter("src < dst").agg(F.count("*").alias("links"))
    return parts.crossJoin(links).select("nodes", "links", "components", (F.col("links") - F.col("nodes") + F.col("components")).alias("cycle_rank"))


CYCLE_RANK_SQL = f"""{WALK}, sizes AS (SELECT count(*) AS nodes, count(DISTINCT component) AS components FROM walk), l AS (SELECT count(*) AS links FROM both_ways WHERE src < dst)
SELECT nodes, links, components, links - nodes + components AS cycle_rank FROM sizes, l"""


def coloring(spark, d):
    pairs = edges(spark, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = written(pairs.distinct(), "pairs")
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg((-F.count("*")).alias("priority"))
    return graph.coloring(pairs, degree)


def coloring_order(spark, d):
    """Where each part stands in the order of coloring: by degree, last shipping day, pieces shipped."""
    facts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.unix_date(F.max("l_shipdate").cast("date")).alias("at"), F.sum("l_quantity").alias("downloads"))
    order = graph.coloring_order(edges(spark, d), facts)
    return ranks.placed(order, [], ["priority", "id"], "place").select("id", "degree", (F.col("place") + 1).alias("place"))


def exclusions(spark, d):
    """Conflict if more than one color is needed; exclusions are the colors less one (an upper bound)."""
    return coloring(spark, d).agg(F.max("color").alias("colors"), (F.max("color") > 1).alias("conflict"), (F.max("color") - 1).alias("exclusions"))


def betweenness(spark, d):
    """From every node; 0 for those on no shortest path."""
    return _round(_round(csr.betweenness(calls(spark, d), nodes(spark, d)), "centrality", digits=4), "normalized", digits=10)


def projection(spark, d):
    out = graph.random_projection(calls(spark, d), dim=8)
    return out.select("id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def composition(spark, d):
    return graph.composed(edges(spark, d), [("CALLS", "IMPORTS", "INFLUENCES")])


def structural_entropy(spark, d):
    deg = graph.degrees(nodes(spark, d), edges(spark, d)).select((F.col("out_degree") + F.col("in_degree")).alias("degree"))
    return _round(graph.entropy(deg, "degree"), "entropy")


def sheaf_score(spark, d):
    """Share of links inside a community less the share between communities, per community."""
    n = nodes(spark, d).select("id", "kind")
    e = edges(spark, d).join(n.toDF("src", "ka"), "src").join(n.toDF("dst", "kb"), "dst")
    inside = F.sum(F.when(F.col("ka") == F.col("kb"), 1).otherwise(0))
    return e.groupBy(F.col("ka").alias("kind")).agg(F.round((2 * inside - F.count("*")) / F.count("*"), 6).alias("score"))


def sensitive_flow(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    guard = e.filter("rel_type = 'DEPENDS_ON'").select(F.col("src").alias("guard"), F.col("dst").alias("process"))
    data = e.filter("rel_type = 'IMPORTS'").join(n.filter("kind = 'PROMO' and size > 45").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("process"), F.col("dst").alias("data"))
    return guard.join(data, "process").groupBy("data").agg(F.countDistinct("guard").alias("guards"), F.countDistinct("process").alias("processes"))


def navigation(spark, d):
    h = hierarchy(spark, d)
    a, b, c = (h.filter(F.col("level") == k).alias(x) for k, x in ((0, "a"), (1, "b"), (2, "c")))
    return a.join(b, F.col("b.parent") == F.col("a.child"), "left").join(c, F.col("c.parent") == F.col("b.child"), "left").groupBy(F.col("a.child").alias("hub"), F.col("b.child").alias("domain")).agg(F.count("c.child").alias("files"))


def participation(spark, d):
    """Hypergraph incidence: an order is a hyperedge, its lines' parts take part as source (even line) or target."""
    inc = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("hyperedge"), F.when(F.col("l_linenumber") % 2 == 0, "SOURCE").otherwise("TARGET").alias("direction"), F.col("l_returnflag").alias("edge_type"))
    return inc.groupBy("node").agg(F.sum(F.when(F.col("direction") == "SOURCE", 1).otherwise(0)).alias("source_count"), F.sum(F.when(F.col("direction") == "TARGET", 1).otherwise(0)).alias("target_count"), F.countDistinct("edge_type").alias("types"), F.countDistinct("hyperedge").alias("hyperedges"))


def detach_delete(spark, d):
    """Removes nodes (those of size 7 or less), their incidence, then hyperedges without any; a node goes whether or not it had some."""
    inc = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("hyperedge"))
    gone = nodes(spark, d).filter("size <= 7").select(F.col("id").alias("node"))
    left = inc.join(gone, "node", "left_anti")
    kept = table(spark, d, "orders").select(F.col("o_orderkey").alias("hyperedge")).join(left.select("hyperedge").distinct(), "hyperedge", "left_semi")
    return kept.agg(F.count("*").alias("hyperedges")).crossJoin(left.agg(F.count("*").alias("incidence"))).crossJoin(nodes(spark, d).filter("size > 7").agg(F.count("*").alias("nodes")))


def method_counts(spark, d):
    return edges(spark, d).groupBy("src", "rel_type").agg(F.count("*").alias("targets"))


def weighted_edges(spark, d):
    return edges(spark, d).filter("weight > 90").select("src", "dst", "rel_type", "weight")


QUERIES = {
    "graph_one_hop": (one_hop, f"{WITH} SELECT a.p_name AS src_name, b.p_type AS dst_kind, count(*) AS calls FROM edges e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE rel_type = 'CALLS' GROUP BY a.p_name, b.p_type"),
    "graph_dependents": (dependents, f"{WITH} SELECT dst AS id, count(DISTINCT src) AS dependents, max(frequency) AS most FROM edges WHERE rel_type IN ('CALLS', 'DEPENDS_ON') GROUP BY dst HAVING count(DISTINCT src) >= 5"),
    "graph_undirected": (undirected_pairs, f"{WITH}, pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges) SELECT a, count(*) AS neighbours FROM pairs GROUP BY a"),
    "graph_chained_pattern": (chained, f"{WITH} SELECT x.src AS a, x.dst AS b, count(DISTINCT y.dst)::INT AS reached, min(y.dst) AS first FROM edges x JOIN edges y ON y.src = x.dst WHERE x.rel_type = 'CALLS' AND x.frequency > 1 AND y.rel_type = 'IMPORTS' GROUP BY x.src, x.dst"),
    "graph_anti_pattern": (isolated, f"{WITH}, used AS (SELECT src AS id FROM edges WHERE frequency > 1 UNION SELECT dst FROM edges WHERE frequency > 1) SELECT p_type AS kind, count(*) AS orphans FROM part WHERE p_partkey NOT IN (SELECT id FROM used) GROUP BY p_type"),
    "graph_exists_pattern": (exists_pattern, f"{WITH} SELECT p_partkey AS id, p_name AS name FROM part WHERE EXISTS (SELECT 1 FROM edges WHERE src = p_partkey AND rel_type = 'DEPENDS_ON' AND weight > 45)"),
    "graph_degree": (degree, f"{WITH} SELECT p_partkey AS id, (SELECT count(*) FROM edges WHERE src = p_partkey AND rel_type = 'CALLS') AS out_degree, (SELECT count(*) FROM edges WHERE dst = p_partkey AND rel_type = 'CALLS') AS in_degree FROM part"),
    "graph_god_classes": (god_classes, f"{WITH}, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) AS degree FROM ends GROUP BY id HAVING count(*) > 30"),
    "graph_pagerank": (pagerank, pagerank_sql()),
    "graph_eigenvector": (eigenvector, None),
    "graph_message_centrality": (message_centrality, message_centrality_sql()),
    "graph_message_labels": (message_labels, MESSAGE_LABELS_SQL),
    "graph_message_distances": (message_distances, MESSAGE_DISTANCES_SQL),
    "graph_strong_components": (strong_components, STRONG_SQL),
    "graph_louvain": (louvain, None),
    "graph_erdos_numbers": (erdos, ERDOS_SQL),
    "graph_shortest_paths": (shortest, shortest_sql()),
    "graph_context": (context, CONTEXT_SQL),
    "graph_linked_exceptions": (exceptions, EXCEPTIONS_SQL),
    "graph_impact_set": (impact, IMPACT_SQL),
    "graph_least_action": (action, ACTION_SQL),
    "graph_variable_paths": (variable_paths, PATHS_SQL),
    "graph_cycles": (cycles, cycles_sql()),
    "graph_shape": (graph_shape, SHAPE_SQL),
    "graph_communities": (communities, communities_sql()),
    "graph_modularity": (modularity, MODULARITY_SQL),
    "graph_components": (components, f"{WALK} SELECT node, component FROM walk"),
    "graph_cycle_rank": (cycle_rank, CYCLE_RANK_SQL),
    "graph_coloring": (coloring, None),
    "graph_coloring_order": (coloring_order, f"{WITH}, near AS (SELECT src AS id, dst AS x FROM edges UNION SELECT dst, src FROM edges), d AS (SELECT id, count(*) AS degree FROM near GROUP BY id), f AS (SELECT l_partkey, max(l_shipdate::DATE) AS newest, sum(l_quantity) AS downloads FROM lineitem GROUP BY 1) SELECT id, degree, row_number() OVER (ORDER BY degree DESC, newest DESC, downloads DESC, id) AS place FROM d JOIN f ON l_partkey = id"),
    "graph_exclusions": (exclusions, None),
    "graph_betweenness": (betweenness, None),
    "graph_random_projection": (projection, None),
    "graph_composition": (composition, f"{WITH} SELECT DISTINCT x.src, y.dst, 'INFLUENCES' AS rel_type FROM edges x JOIN edges y ON y.src = x.dst WHERE x.rel_type = 'CALLS' AND y.rel_type = 'IMPORTS'"),
    "graph_structural_entropy": (structural_entropy, f"{WITH}, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT count(*)::DOUBLE AS d FROM ends GROUP BY id), t AS (SELECT sum(d) AS t FROM d) SELECT round(-sum(d / t * ln(d / t)), 6) AS entropy FROM d, t"),
    "graph_sheaf_score": (sheaf_score, f"{WITH} SELECT a.p_type AS kind, round((2.0::DOUBLE * sum(CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0 END) - count(*)) / count(*), 6) AS score FROM edges e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst GROUP BY a.p_type"),
    "graph_sensitive_flow": (sensitive_flow, f"{WITH} SELECT y.dst AS data, count(DISTINCT x.src) AS guards, count(DISTINCT x.dst) AS processes FROM edges x JOIN edges y ON y.src = x.dst JOIN part p ON p.p_partkey = y.dst WHERE x.rel_type = 'DEPENDS_ON' AND y.rel_type = 'IMPORTS' AND p.p_type = 'PROMO' AND p.p_size > 45 GROUP BY y.dst"),
    "graph_hub_navigation": (navigation, "SELECT 'hub:' || r_regionkey AS hub, 'domain:' || n_nationkey AS domain, count(c_custkey) AS files FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey, n_nationkey"),
    "hypergraph_participation": (participation, "SELECT l_partkey AS node, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS source_count, sum(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END)::BIGINT AS target_count, count(DISTINCT l_returnflag) AS types, count(DISTINCT l_orderkey) AS hyperedges FROM lineitem GROUP BY l_partkey"),
    "hypergraph_detach_delete": (detach_delete, "WITH kept AS (SELECT * FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 7)) SELECT (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM kept)) AS hyperedges, (SELECT count(*) FROM kept) AS incidence, (SELECT count(*) FROM part WHERE p_size > 7) AS nodes"),
    "graph_method_counts": (method_counts, f"{WITH} SELECT src, rel_type, count(*) AS targets FROM edges GROUP BY src, rel_type"),
    "graph_weighted_edges": (weighted_edges, f"{WITH} SELECT src, dst, rel_type, weight FROM edges WHERE weight > 90"),
}
