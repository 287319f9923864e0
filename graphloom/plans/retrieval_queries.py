"""Queries of lexical, vector and hybrid retrieval and of scoring over the memory graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import retrieval as R
from graphloom.plans.catalog import MEMORY_SQL, Catalog
from graphloom.plans.hits import HITS_SQL, hits
from graphloom.sources.graph_tables import memory_edges, memory_nodes
from graphloom.session import table

catalog = Catalog()
_STOPS = "(" + ", ".join(f"'{w}'" for w in __import__("graphloom.functions.text", fromlist=["x"]).STOP_WORDS) + ")"
_WORDS = f"""docs AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: x NOT IN {_STOPS}) AS words FROM documents WHERE text IS NOT NULL),
full_docs AS (SELECT doc_id, words, len(words) AS n FROM docs WHERE len(words) > 0),
asked AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(item_text), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: x NOT IN {_STOPS}) AS words FROM eval_items)"""


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("item_text").alias("text"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")


BM25_SQL = f"""{_WORDS}, t AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM full_docs),
post AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM full_docs) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT query_id, unnest(words) AS term FROM asked),
s AS (SELECT query_id, doc_id, sum(greatest(1e-5, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score
FROM qt JOIN df USING (term) JOIN post USING (term) CROSS JOIN t GROUP BY 1, 2 HAVING score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""
_BM25 = f"WITH {BM25_SQL}"


def _bm25_ranked(spark, sf_dir, k):
    scores = R.bm25(_documents(spark, sf_dir), _queries(spark, sf_dir))
    return R.top_k(scores, ["query_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], k)


@catalog.query(_BM25 + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25_ranked(spark, sf_dir, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@catalog.query(
    f"""WITH {_WORDS}, d AS (SELECT doc_id, list_distinct(words) AS w FROM docs), q AS (SELECT query_id, list_distinct(words) AS w FROM asked),
dt AS (SELECT doc_id, len(w) AS nd, unnest(w) AS term FROM d), qt AS (SELECT query_id, len(w) AS nq, unnest(w) AS term FROM q),
s AS (SELECT query_id, doc_id, count(*) / (nd + nq - count(*)) AS score FROM qt JOIN dt USING (term) GROUP BY query_id, doc_id, nd, nq),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""
)
def jaccard_topk(spark, sf_dir):
    scores = R.jaccard(_documents(spark, sf_dir), _queries(spark, sf_dir))
    ranked = R.top_k(scores, ["query_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], 10)
    return ranked.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_KNN = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
k AS (SELECT b.vec_id AS query_id, a.vec_id, 1 - {_COS} AS distance FROM v a JOIN v b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM k)"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    # the stated query set: every row whose id is divisible by 100, against all rows
    return rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@catalog.query(_KNN + " SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10")
def knn(spark, sf_dir):
    rows, queries = _vectors(spark, sf_dir)
    return R.nearest(rows, queries, 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@catalog.query(
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
k AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 9) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM k)
SELECT query_id, vec_id, round(sim, 6) AS similarity, sim >= 0.9 AS matched FROM r WHERE rank = 1"""
)
def semantic_match(spark, sf_dir):
    """The most similar vector of the same type, and whether it is similar enough to be the same."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vec"))
    pairs = rows.join(asked, "label").where("vec_id <> query_id")
    sim = F.round(V.cosine(F.col("embedding"), F.col("query_vec")), 9)
    scored = pairs.select("query_id", "vec_id", sim.alias("sim"))
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("sim")).alias("k"), "vec_id")).alias("b"))
    return best.select("query_id", "b.vec_id", F.round(-F.col("b.k"), 6).alias("similarity"), (-F.col("b.k") >= 0.9).alias("matched"))


@catalog.query(
    _KNN.replace("WITH v", "WITH v", 1)
    + f""", {_BM25.removeprefix("WITH ")}, dense AS (SELECT query_id, vec_id AS id, rank FROM r WHERE rank <= 20),
sparse AS (SELECT query_id, doc_id AS id, rank FROM ranked WHERE rank <= 20), f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id,
coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS rrf FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.id = s.id)
SELECT query_id, id, round(CASE WHEN max(rrf) OVER w = min(rrf) OVER w THEN 0 ELSE 1 - (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) END, 6) AS distance
FROM f WINDOW w AS (PARTITION BY query_id)"""
)
def rrf_hybrid(spark, sf_dir):
    rows, queries = _vectors(spark, sf_dir)
    dense = R.nearest(rows, queries, 20).select("query_id", F.col("vec_id").alias("id"), "rank")
    sparse = _bm25_ranked(spark, sf_dir, 20).select("query_id", F.col("doc_id").alias("id"), "rank")
    return R.rrf(dense, sparse, ["query_id", "id"]).select("query_id", "id", F.round("distance", 6).alias("distance"))


@catalog.query(
    f"""WITH {_WORDS}, w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM full_docs),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c)
SELECT doc_id, string_agg(word, ', ' ORDER BY k) AS title FROM r WHERE k <= 3 GROUP BY doc_id"""
)
def top_words(spark, sf_dir):
    """The three most frequent content words of a text, ties by first use."""
    from graphloom.functions.text import content_tokens

    words = _documents(spark, sf_dir).select("doc_id", F.posexplode(content_tokens(F.col("text"))).alias("pos", "word"))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    ranked = R.top_k(counted, ["doc_id"], [F.desc("n"), F.col("first")], 3)
    return ranked.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x.word), ", ").alias("title")
    )


# -- memory graph ------------------------------------------------------------------
def _hits(spark, sf_dir):
    return hits(spark, sf_dir).select("id", F.col("d").alias("score"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, {HITS_SQL},
ef AS (SELECT DISTINCT src AS episode, dst AS facet FROM me WHERE relationship_name = 'has_facet'), fp AS (SELECT DISTINCT src AS facet, dst AS point FROM me WHERE relationship_name = 'has_point'),
en AS (SELECT DISTINCT src AS holder, dst AS entity FROM me WHERE relationship_name = 'involves_entity'),
fw AS (SELECT id AS facet, d AS c, 1 AS k FROM h UNION ALL SELECT facet, d + 0.9 + 0.05, 2 FROM fp JOIN h ON h.id = fp.point UNION ALL SELECT holder, d + 0.9 + 0.05, 3 FROM en JOIN h ON h.id = en.entity),
fc AS (SELECT facet, min(ROW(c, k)) AS w FROM fw GROUP BY facet), x AS (
SELECT episode, d + 0.3 AS c, 0 AS k FROM (SELECT episode FROM ef UNION SELECT holder FROM en) JOIN h ON h.id = episode
UNION ALL SELECT episode, fc.w[1] + CASE WHEN d < 0.1 THEN 0.1 WHEN d < 0.2 THEN 0.9 * 0.3 ELSE 0.9 END + CASE WHEN d < 0.1 THEN 0.05 WHEN d < 0.2 THEN 0.05 * 0.3 ELSE 0.05 END, fc.w[2]
FROM ef JOIN fc USING (facet) LEFT JOIN h ON h.id = ef.facet
UNION ALL SELECT holder, d + 0.9 + 0.05, 4 FROM en JOIN h ON h.id = en.entity WHERE holder IN (SELECT episode FROM ef))
SELECT episode, round(min(ROW(c, k))[1], 6) AS score, ['direct_episode', 'facet', 'point', 'facet_entity', 'entity'][min(ROW(c, k))[2] + 1] AS path FROM x GROUP BY episode"""
)
def episode_bundles(spark, sf_dir):
    return R.episode_bundles(memory_edges(spark, sf_dir), _hits(spark, sf_dir))


@catalog.query(
    f"""WITH {MEMORY_SQL}, {HITS_SQL},
t AS (SELECT me.src, me.dst, me.relationship_name, coalesce(a.d, 3.5) + coalesce(b.d, 3.5) + 3.5 AS cost FROM me JOIN m x ON x.id = me.src JOIN m y ON y.id = me.dst
LEFT JOIN h a ON a.id = me.src LEFT JOIN h b ON b.id = me.dst)
SELECT src, dst, relationship_name, round(cost, 6) AS cost FROM t ORDER BY cost, src, dst, relationship_name LIMIT 20"""
)
def triplet_importance(spark, sf_dir):
    """The 20 triplets whose two ends and edge are nearest together; a miss costs 3.5."""
    hits = _hits(spark, sf_dir)
    ids = memory_nodes(spark, sf_dir).select("id")
    rows = memory_edges(spark, sf_dir)
    for end in ("src", "dst"):
        rows = rows.join(ids.withColumnRenamed("id", end), end, "left_semi")
        rows = rows.join(hits.select(F.col("id").alias(end), F.col("score").alias(f"{end}_d")), end, "left")
    cost = F.coalesce("src_d", F.lit(3.5)) + F.coalesce("dst_d", F.lit(3.5)) + 3.5
    best = rows.withColumn("cost", cost).orderBy("cost", "src", "dst", "relationship_name").limit(20)
    return best.select("src", "dst", "relationship_name", F.round("cost", 6).alias("cost"))


_Q0, _Q1 = 1735689600000, 1751328000000


@catalog.query(
    f"""WITH {MEMORY_SQL}, x AS (SELECT id, mentioned_time_start_ms AS c0, mentioned_time_end_ms AS c1, mentioned_time_confidence AS conf, created_at,
least(mentioned_time_end_ms, {_Q1}) - greatest(mentioned_time_start_ms, {_Q0}) AS common, least(mentioned_time_end_ms - mentioned_time_start_ms, {_Q1} - {_Q0}) AS shorter FROM m)
SELECT id, round(least(0.06, CASE WHEN c0 IS NOT NULL AND c1 IS NOT NULL THEN CASE WHEN common <= 0 OR shorter <= 0 THEN 0 ELSE least(1.0, common / shorter) END * coalesce(conf, 0.7)
WHEN created_at BETWEEN {_Q0} AND {_Q1} THEN 0.5 ELSE 0 END * 0.9 * 0.06), 6) AS bonus FROM x"""
)
def time_bonus(spark, sf_dir):
    c = F.col
    bonus = R.time_bonus(
        c("mentioned_time_start_ms"), c("mentioned_time_end_ms"), c("mentioned_time_confidence"), c("created_at"), F.lit(_Q0), F.lit(_Q1), 0.9
    )
    return memory_nodes(spark, sf_dir).select("id", F.round(bonus, 6).alias("bonus"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, {HITS_SQL}, hr AS (SELECT node_type, d, row_number() OVER (PARTITION BY node_type ORDER BY d, id) AS r FROM h),
g AS (SELECT node_type, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM hr GROUP BY 1),
f AS (SELECT node_type, d1, greatest(0, d2 - d1) AS gap, d1 / 0.6 AS ratio FROM g)
SELECT node_type, round(d1, 6) AS best, round((CASE WHEN ratio <= 0.5 THEN 1 WHEN ratio <= 1 THEN 1 - (ratio - 0.5) WHEN ratio <= 1.5 THEN 0.5 - (ratio - 1) * 0.4 ELSE greatest(0.1, 0.3 - (ratio - 1.5) * 0.2) END)
* (CASE WHEN gap < 0.01 THEN 0.2 WHEN gap <= 0.05 THEN 0.2 + (gap - 0.01) / 0.04 * 0.4 WHEN gap < 0.15 THEN 0.6 + (gap - 0.05) / 0.1 * 0.4 ELSE 1 END), 6) AS confidence FROM f"""
)
def collection_confidence(spark, sf_dir):
    """How far the best hit of each collection can be trusted, by its distance and its lead."""
    rows = R.top_k(hits(spark, sf_dir), ["node_type"], [F.col("d"), F.col("id")], 2)
    best = rows.groupBy("node_type").agg(F.max(F.when(F.col("rank") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("d"))).alias("d2"))
    gap = F.greatest(F.lit(0.0), F.col("d2") - F.col("d1"))
    confidence = R.distance_factor(F.col("d1") / 0.6) * R.gap_factor(gap)
    return best.select("node_type", F.round("d1", 6).alias("best"), F.round(confidence, 6).alias("confidence"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
