"""Queries that turn hits into what a recall returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import assembly as A
from graphloom.operators import retrieval as R
from graphloom.plans.catalog import MEMORY_SQL, Catalog
from graphloom.plans.hits import HITS_SQL, MANY_SQL, hits, many_hits
from graphloom.sources.graph_tables import memory_edges, memory_nodes
from graphloom.session import table

catalog = Catalog()
_BASE = f"{MEMORY_SQL}, {HITS_SQL}"
_MANY = f"{_BASE}, {MANY_SQL}"
_MIXED = "索引 index 353 megabytes 12 天"


def _text():
    return F.coalesce("summary", "search_text", "description", "node_name", F.lit(""))


def _links(spark, sf_dir, relation, a, b):
    return memory_edges(spark, sf_dir, relation).select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()


def _numbers(x: str) -> str:
    united = f"list_transform(regexp_extract_all({x}, '(?i)([0-9]+\\.?[0-9]*\\s*(?:{A.UNITS}))', 1), lambda u: lower(regexp_replace(u, '\\s', '', 'g')))"
    return f"list_concat({united}, regexp_extract_all(regexp_replace({x}, '(?i)([0-9]+\\.?[0-9]*)\\s*({A.UNITS})', ' ', 'g'), '\\b([0-9]+\\.?[0-9]*)\\b', 1))"


_DIGITS = "regexp_extract(x, '^([0-9]+\\.?[0-9]*)', 1)"
_LATIN = "'([A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]|[A-Za-z]{2,})'"


@catalog.query(
    f"""WITH {_BASE}, t AS (SELECT h.id, d, coalesce(summary, search_text, description, node_name, '') AS text FROM h JOIN m USING (id)), k AS (SELECT id, d, text, list_distinct({_numbers(f"'{_MIXED}'")}) AS asked, {_numbers('text')} AS known FROM t),
b AS (SELECT id, d, text, len(list_filter(asked, lambda x: list_contains(known, x))) AS f, len(list_filter(asked, lambda x: NOT list_contains(known, x) AND list_contains(list_transform(known, lambda x: {_DIGITS}), {_DIGITS}))) AS p,
len(list_intersect(regexp_extract_all(lower('{_MIXED}'), {_LATIN}, 1), regexp_extract_all(lower(text), {_LATIN}, 1))) AS w FROM k)
SELECT id, round(CASE WHEN d >= 0.1 THEN greatest(0, d - least(f * 0.12 + p * 0.03, 0.24) - least(w * 0.08, 0.16)) ELSE d END, 6) AS exact,
round(CASE WHEN contains(regexp_replace(lower(text), '\\s+', '', 'g'), 'theindex') THEN greatest(0, d - 0.15) ELSE d END, 6) AS keyword FROM b"""
)
def match_bonuses(spark, sf_dir):
    """The distances of hits with the bonus for numbers and Latin words of a mixed question, and with that for a keyword."""
    rows = hits(spark, sf_dir).select("id", "d").join(memory_nodes(spark, sf_dir).select("id", _text().alias("text")), "id")
    exact = A.with_exact_bonus(F.col("d"), F.lit(_MIXED), F.col("text"))
    return rows.select("id", F.round(exact, 6).alias("exact"), F.round(A.with_keyword_bonus(F.col("d"), F.lit("the index"), F.col("text")), 6).alias("keyword"))


@catalog.query(
    f"""WITH {_BASE}, b AS (SELECT id, d, CASE WHEN created_at >= 1735689600000 THEN 0.5 * 0.06 ELSE 0 END AS bonus, CASE WHEN mentioned_time_end_ms < 1735689600000 THEN 0.02 ELSE 0 END AS penalty FROM h JOIN m USING (id))
SELECT id, round(greatest(0.08, d - bonus) + penalty, 6) AS score, bonus > 0 AS matched FROM b"""
)
def time_weighted_hits(spark, sf_dir):
    """Hits with the bonus of their age and the penalty of a mentioned time that is over."""
    bonus = F.when(F.col("created_at") >= 1735689600000, 0.5 * 0.06).otherwise(0.0)
    penalty = F.when(F.col("mentioned_time_end_ms") < 1735689600000, 0.02).otherwise(0.0)
    rows = hits(spark, sf_dir).select("id", "d").join(memory_nodes(spark, sf_dir), "id").select("id", "d", bonus.alias("bonus"), penalty.alias("penalty"))
    return rows.select("id", F.round(A.with_time_bonus(F.col("d"), F.col("bonus"), F.col("penalty")), 6).alias("score"), (F.col("bonus") > 0).alias("matched"))


_SUMMARIES = f"""{_BASE}, f AS (SELECT DISTINCT me.src AS episode, me.dst AS facet FROM me WHERE relationship_name = 'has_facet'), s AS (SELECT episode, string_agg('【' || coalesce(node_name, '') || '】' || coalesce(description, ''), ' ' ORDER BY facet) AS summary FROM f JOIN m ON m.id = f.facet GROUP BY 1),
g AS (SELECT episode, list(lower(trim(m.node_name))) AS names FROM f JOIN h ON h.id = f.facet JOIN m ON m.id = f.facet WHERE m.node_name IS NOT NULL GROUP BY 1),
z AS (SELECT episode, summary, regexp_extract_all(summary, '【([^】]*)】[^【]*', 1) AS t, regexp_extract_all(summary, '(【[^】]*】[^【]*)', 1) AS w, coalesce(names, []) AS names FROM s LEFT JOIN g USING (episode)),
k AS (SELECT episode, summary, list_filter(w, lambda x, i: list_contains(names, lower(trim(t[i])))) AS kept FROM z)"""


@catalog.query(
    f"""WITH {_SUMMARIES} SELECT 'summary' AS mode, episode, NULL AS other, summary AS text FROM k UNION ALL SELECT 'highly_related_summary', episode, NULL, CASE WHEN len(kept) > 0 THEN trim(array_to_string(list_transform(kept, lambda x: trim(x)), ' ')) ELSE summary END FROM k
UNION ALL SELECT 'detail', f.episode, f.facet, coalesce(m.search_text, '') FROM f JOIN h ON h.id = f.facet JOIN m ON m.id = f.facet"""
)
def output_modes(spark, sf_dir):
    """What a recall returns: whole summaries, their sections of facets that were hit, or the edges to these facets."""
    nodes = memory_nodes(spark, sf_dir).select(F.col("id").alias("facet"), "node_name", "description", "search_text")
    f = _links(spark, sf_dir, "has_facet", "episode", "facet").join(nodes, "facet")
    section = F.concat(F.lit("【"), F.coalesce("node_name", F.lit("")), F.lit("】"), F.coalesce("description", F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("facet", section.alias("s")))), lambda x: x.s)
    whole = f.groupBy("episode").agg(F.array_join(listed, " ").alias("summary"))
    hit = f.join(hits(spark, sf_dir).select(F.col("id").alias("facet")), "facet", "left_semi")
    names = hit.groupBy("episode").agg(F.collect_list("node_name").alias("names"))
    joined = whole.join(names, "episode", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    none = F.lit(None).cast("string")
    summary = joined.select(F.lit("summary").alias("mode"), "episode", none.alias("other"), F.col("summary").alias("text"))
    related = joined.select(F.lit("highly_related_summary").alias("mode"), "episode", none.alias("other"), A.keep_sections(F.col("summary"), F.col("names")).alias("text"))
    detail = hit.select(F.lit("detail").alias("mode"), "episode", F.col("facet").alias("other"), F.coalesce("search_text", F.lit("")).alias("text"))
    return summary.unionByName(related).unionByName(detail)


_EDGES = f"""{_MANY}, x AS (SELECT hm.query_id, e.src, e.dst, e.relationship_name, coalesce(a.d, 0.9) AS src_cost, hm.d AS dst_cost, hm.rank AS episode_rank, CASE WHEN m.created_at >= 1735689600000 THEN 0.03 ELSE 0 END AS te
FROM hm JOIN (SELECT DISTINCT src, dst, relationship_name FROM me) e ON e.dst = hm.id JOIN m ON m.id = hm.id LEFT JOIN hm a ON a.id = e.src AND a.query_id = hm.query_id),
o AS (SELECT *, coalesce(nullif(list_position(['has_point', 'has_facet', 'involves_entity'], relationship_name), 0), 9) AS ro, 0.7 * dst_cost + 0.3 * (1 - 1 / (1 + 0.5 * episode_rank)) AS final FROM x)"""


@catalog.query(
    f"""WITH {_EDGES} SELECT query_id, src, dst, relationship_name, row_number() OVER (PARTITION BY query_id ORDER BY episode_rank, round(least(src_cost, dst_cost) - te, 9), 0.9, ro, src, dst) AS basic,
row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.08, final - te), 9), ro, src, dst) AS adaptive FROM o"""
)
def sorted_edges(spark, sf_dir):
    """The edges to the hits of several questions in the basic and in the adaptive order."""
    found = many_hits(spark, sf_dir)
    nodes = memory_nodes(spark, sf_dir)
    links = memory_edges(spark, sf_dir).select("src", "dst", "relationship_name").distinct()
    rows = found.select("query_id", F.col("id").alias("dst"), F.col("d").alias("dst_cost"), F.col("rank").alias("episode_rank")).join(links, "dst")
    rows = rows.join(nodes.select(F.col("id").alias("dst"), "created_at"), "dst").join(found.select("query_id", F.col("id").alias("src"), F.col("d").alias("src_cost")), ["query_id", "src"], "left")
    late = F.col("created_at") >= 1735689600000
    final = 0.7 * F.col("dst_cost") + 0.3 * (1 - 1 / (1 + 0.5 * F.col("episode_rank")))
    rows = rows.withColumns({"src_cost": F.coalesce("src_cost", F.lit(0.9)), "edge_cost": F.lit(0.9), "time_effect": F.when(late, 0.03).otherwise(0.0), "final": final})
    basic = A.sort_edges(rows, "basic").withColumnRenamed("position", "basic")
    return A.sort_edges(basic, "adaptive").select("query_id", "src", "dst", "relationship_name", "basic", F.col("position").alias("adaptive"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, f AS (SELECT DISTINCT src AS procedure, dst AS pack FROM me WHERE relationship_name = 'has_facet'), p AS (SELECT DISTINCT src AS pack, dst AS point FROM me WHERE relationship_name = 'has_point'), d AS (SELECT DISTINCT src AS procedure, dst AS point FROM me WHERE relationship_name = 'involves_entity')
SELECT procedure, point, 'direct' AS via FROM d UNION ALL SELECT DISTINCT procedure, point, 'pack' FROM f JOIN p USING (pack) WHERE (procedure, point) NOT IN (SELECT procedure, point FROM d WHERE procedure IS NOT NULL AND point IS NOT NULL)"""
)
def folded_packs(spark, sf_dir):
    """Points behind packs as points of the procedure; episodes, facets and points stand for these."""
    return A.fold_packs(_links(spark, sf_dir, "has_facet", "procedure", "pack"), _links(spark, sf_dir, "has_point", "pack", "point"), _links(spark, sf_dir, "involves_entity", "procedure", "point"))


@catalog.query(
    f"""WITH {_MANY}, r AS (SELECT query_id, id, node_type, d, row_number() OVER (PARTITION BY query_id, node_type ORDER BY d, id) AS place FROM hm)
SELECT query_id, id, node_type, place FROM r WHERE place <= CASE node_type WHEN 'FacetPoint' THEN 6 WHEN 'Facet' THEN 4 WHEN 'Episode' THEN 2 END"""
)
def orchestrated_recall(spark, sf_dir):
    """The hits of each question within the budgets of three kinds of memory: six points, four facets, two episodes."""
    return A.budgets(many_hits(spark, sf_dir), "node_type", {"FacetPoint": 6, "Facet": 4, "Episode": 2}).select("query_id", "id", "node_type", "place")


@catalog.query(
    f"""WITH {_MANY}, s AS (SELECT id, query_id, round(d / CASE query_id WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END, 9) AS s FROM hm) SELECT id, round(min(s), 6) AS score, count(DISTINCT query_id) AS queries FROM s GROUP BY id ORDER BY min(s), id LIMIT 5"""
)
def multi_query_recall(spark, sf_dir):
    """The five best ids over three questions of different weight."""
    best = A.best_of_queries(many_hits(spark, sf_dir), {0: 1.0, 1: 0.8, 2: 0.5}, 5)
    return best.select("id", F.round("score", 6).alias("score"), "queries")


@catalog.query(
    f"""WITH {_MANY}, u AS (SELECT query_id, id AS episode, 'summary' AS source, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM hm WHERE node_type = 'Episode'
UNION ALL SELECT query_id, src, 'facet', row_number() OVER (PARTITION BY query_id ORDER BY d, src, dst) FROM hm JOIN (SELECT DISTINCT src, dst FROM me WHERE relationship_name = 'has_facet') e ON e.dst = hm.id),
g AS (SELECT query_id, episode, min(rank) AS best, min(CASE WHEN source = 'summary' THEN rank END) AS s, min(CASE WHEN source = 'facet' THEN rank END) AS f FROM u GROUP BY 1, 2)
SELECT query_id, episode, rank, coalesce(s <= 3 AND f <= 5, false) AS merges FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, episode) AS rank FROM g) WHERE rank <= 5"""
)
def episode_routes(spark, sf_dir):
    """The episodes that a document with these questions would go to, by summaries and facets."""
    found = many_hits(spark, sf_dir)
    own = R.top_k(found.where("node_type = 'Episode'").select("query_id", "d", F.col("id").alias("episode")), ["query_id"], [F.col("d"), F.col("episode")], 10**6)
    via = found.select("query_id", "d", F.col("id").alias("facet")).join(_links(spark, sf_dir, "has_facet", "episode", "facet"), "facet")
    via = R.top_k(via, ["query_id"], [F.col("d"), F.col("episode"), F.col("facet")], 10**6)
    ranks = own.select("query_id", "episode", F.lit("summary").alias("source"), "rank").unionByName(via.select("query_id", "episode", F.lit("facet").alias("source"), "rank"))
    return A.route(ranks)


@catalog.query(
    f"""WITH {_MANY}, c AS (SELECT query_id, id, node_type, row_number() OVER (PARTITION BY query_id, node_type ORDER BY d, id) AS r, d FROM hm), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM c WHERE r <= 5 AND d <= 1.2)
SELECT query_id, id, node_type, round(d, 6) AS d, rank FROM a WHERE rank <= 5"""
)
def similar_procedures(spark, sf_dir):
    """The five nearest records over all collections, of each the five nearest, within a distance of 1.2."""
    best = R.top_k(many_hits(spark, sf_dir).drop("rank"), ["query_id", "node_type"], [F.col("d"), F.col("id")], 5, "r").where("d <= 1.2")
    return R.top_k(best, ["query_id"], [F.col("d"), F.col("id")], 5).select("query_id", "id", "node_type", F.round("d", 6).alias("d"), "rank")


@catalog.query(
    f"""WITH {_MANY}, l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY length(coalesce(m.search_text, m.summary, m.description, '')), id) AS rank FROM hm JOIN m USING (id)),
f AS (SELECT hm.query_id, hm.id, 1.0 / (60 + hm.rank) + 1.0 / (60 + l.rank) AS s FROM hm JOIN l ON l.query_id = hm.query_id AND l.id = hm.id), r AS (SELECT query_id, id, 1 - (s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0) AS d FROM f WINDOW w AS (PARTITION BY query_id)),
t AS (SELECT q.query_id, e.src, e.dst, e.relationship_name, coalesce(a.d, 3.5) + coalesce(b.d, 3.5) + 3.5 AS cost FROM (SELECT DISTINCT src, dst, relationship_name FROM me) e CROSS JOIN (SELECT DISTINCT query_id FROM hm) q LEFT JOIN r a ON a.id = e.src AND a.query_id = q.query_id LEFT JOIN r b ON b.id = e.dst AND b.query_id = q.query_id WHERE a.d IS NOT NULL OR b.d IS NOT NULL)
SELECT query_id, src, dst, relationship_name, round(cost, 6) AS cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cost, 9), src, dst, relationship_name) AS rank FROM t) WHERE rank <= 5"""
)
def hybrid_triplets(spark, sf_dir):
    """The five best triplets of each question over two fused rankings, by words and by shortness; a missing distance costs 3.5."""
    found = many_hits(spark, sf_dir)
    size = F.char_length(F.coalesce("search_text", "summary", "description", F.lit("")))
    texts = memory_nodes(spark, sf_dir).select("id", size.alias("size"))
    second = R.top_k(found.select("query_id", "id").join(texts, "id"), ["query_id"], [F.col("size"), F.col("id")], 10**6, "second")
    both = found.select("query_id", "id", "rank").join(second.select("query_id", "id", "second"), ["query_id", "id"])
    w = Window.partitionBy("query_id")
    s = both.withColumn("s", 1.0 / (60 + F.col("rank")) + 1.0 / (60 + F.col("second")))
    low, high = F.min("s").over(w), F.max("s").over(w)
    near = s.withColumn("d", 1 - (F.col("s") - low) / F.nullif(high - low, F.lit(0.0))).select("query_id", "id", "d")
    links = memory_edges(spark, sf_dir).select("src", "dst", "relationship_name").distinct()
    hit = near.where("d is not null")
    # only edges with a hit at one end can be among the best
    left = links.join(hit.select("query_id", F.col("id").alias("src")), "src")
    right = links.join(hit.select("query_id", F.col("id").alias("dst")), "dst")
    cost = left.unionByName(right).distinct()
    for end in ("src", "dst"):
        cost = cost.join(hit.select("query_id", F.col("id").alias(end), F.col("d").alias(f"{end}_d")), ["query_id", end], "left")
    cost = cost.withColumn("cost", F.coalesce("src_d", F.lit(3.5)) + F.coalesce("dst_d", F.lit(3.5)) + 3.5)
    best = R.top_k(cost, ["query_id"], [F.round("cost", 9), F.col("src"), F.col("dst"), F.col("relationship_name")], 5)
    return best.select("query_id", "src", "dst", "relationship_name", F.round("cost", 6).alias("cost"), "rank")


@catalog.query("SELECT doc_id, substr(text, 1, 500) AS query, 1.0::DOUBLE AS weight FROM documents WHERE text IS NOT NULL")
def procedural_queries(spark, sf_dir):
    """The one query that is asked for a message: its first 500 characters, with full weight."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.substring("text", 1, 500).alias("query"), F.lit(1.0).alias("weight"))


@catalog.query(
    f"""WITH {_MANY}, t AS (SELECT hm.query_id, hm.id, hm.rank, hm.d, coalesce(m.status, 'active') AS status, lead(hm.d) OVER (PARTITION BY hm.query_id ORDER BY hm.rank) AS next FROM hm JOIN m USING (id) WHERE hm.rank <= 3)
SELECT query_id, bool_or(status = 'active') AS active_hit, array_to_string(list_filter([CASE WHEN count(*) < 3 THEN 'too few' END, CASE WHEN min(d) > 0.25 THEN 'too far' END, CASE WHEN max(CASE WHEN rank = 1 THEN next - d END) < 0.1 THEN 'no lead' END, CASE WHEN bool_or(status = 'deprecated') THEN 'deprecated' END], lambda x: x IS NOT NULL), ',') AS reasons FROM t GROUP BY 1"""
)
def injection_checks(spark, sf_dir):
    """Whether one of a question's first three hits is active, and what speaks against injecting them."""
    status = memory_nodes(spark, sf_dir).select("id", F.coalesce("status", F.lit("active")).alias("status"))
    top = many_hits(spark, sf_dir).where("rank <= 3").join(status, "id")
    g = top.groupBy("query_id").agg(
        F.bool_or(F.col("status") == "active").alias("active_hit"), F.bool_or(F.col("status") == "deprecated").alias("old"), F.count("*").alias("n"), F.min("d").alias("first"), F.min(F.when(F.col("rank") == 2, F.col("d"))).alias("second")
    )
    reasons = F.array_compact(
        F.array(F.when(F.col("n") < 3, "too few"), F.when(F.col("first") > 0.25, "too far"), F.when(F.col("second") - F.col("first") < 0.1, "no lead"), F.when(F.col("old"), "deprecated"))
    )
    return g.select("query_id", "active_hit", F.array_join(reasons, ",").alias("reasons"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
