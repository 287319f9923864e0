"""Hits of one question in the texts of the memory graph, which the queries of scoring start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import STOP_WORDS
from graphloom.operators import retrieval as R
from graphloom.sources.graph_tables import memory_nodes

QUESTION = "why does the index of the layer wait until the weight of the queue was loaded by the customer"
#: How many hits the search keeps.
WIDE = 100


def hits(spark, sf_dir: str) -> DataFrame:
    """(id, node_type, d): the best hits by BM25, with a distance from 0 for the best towards 1."""
    nodes = memory_nodes(spark, sf_dir)
    text = F.coalesce("summary", "search_text", "description", "node_name", F.lit(""))
    asked = spark.range(1).select(F.lit(1).alias("query_id"), F.lit(QUESTION).alias("text"))
    scores = R.bm25(nodes.select(F.col("id").alias("doc_id"), text.alias("text")), asked)
    top = R.top_k(scores, ["query_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], WIDE)
    best = F.max("score").over(Window.partitionBy("query_id"))  # over the hits kept
    kinds = nodes.select("id", "node_type")
    return top.select(F.col("doc_id").alias("id"), F.round(1 - F.col("score") / best, 9).alias("d")).join(kinds, "id")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = "list_filter(regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: x NOT IN ({}))"
_NODE_TOKENS = _TOKENS.format("coalesce(summary, search_text, description, node_name, '')", _STOPS)
_ASKED_TOKENS = _TOKENS.format(f"'{QUESTION}'", _STOPS)
#: CTEs behind MEMORY_SQL that end in h (id, node_type, d).
HITS_SQL = f"""hw AS (SELECT id, {_NODE_TOKENS} AS words FROM m), hf AS (SELECT id, words, len(words) AS n FROM hw WHERE len(words) > 0),
ht AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM hf), hp AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(words) AS term FROM hf) GROUP BY 1, 2, 3),
hd AS (SELECT term, count(*) AS df FROM hp GROUP BY 1), hq AS (SELECT unnest({_ASKED_TOKENS}) AS term),
hs AS (SELECT id, sum(greatest(1e-5, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM hq JOIN hd USING (term) JOIN hp USING (term) CROSS JOIN ht GROUP BY 1),
hk AS (SELECT * FROM hs WHERE score > 0 QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, id) <= {WIDE}),
h AS (SELECT hk.id, m.node_type, round(1 - score / (SELECT max(score) FROM hk), 9) AS d FROM hk JOIN m USING (id))"""


#: Other questions, for searches by several queries; their words are those of the tables' sentences.
QUESTIONS = ("which customer asked for the index of 353 megabytes after the change", "how is the payload of the request derived from its parents", QUESTION)


def many_hits(spark, sf_dir: str, k: int = 40) -> DataFrame:
    """(query_id, id, node_type, d, rank): the best ``k`` hits of each of QUESTIONS, distances as in ``hits``."""
    nodes = memory_nodes(spark, sf_dir)
    text = F.coalesce("summary", "search_text", "description", "node_name", F.lit(""))
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, text string")
    scores = R.bm25(nodes.select(F.col("id").alias("doc_id"), text.alias("text")), asked)
    top = R.top_k(scores, ["query_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    found = top.select("query_id", F.col("doc_id").alias("id"), F.round(1 - F.col("score") / best, 9).alias("d"), "rank")
    return found.join(nodes.select("id", "node_type"), "id")


_ASKED = ", ".join(f"({k}, {_TOKENS.format(chr(39) + q + chr(39), _STOPS)})" for k, q in enumerate(QUESTIONS))
#: CTEs behind MEMORY_SQL and HITS_SQL that end in hm (query_id, id, node_type, d, rank).
MANY_SQL = f"""hmq AS (SELECT query_id, unnest(words) AS term FROM (VALUES {_ASKED}) v(query_id, words)),
hms AS (SELECT query_id, id, sum(greatest(1e-5, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM hmq JOIN hd USING (term) JOIN hp USING (term) CROSS JOIN ht GROUP BY 1, 2),
hmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM hms WHERE score > 0),
hm AS (SELECT query_id, hmr.id, m.node_type, round(1 - score / best, 9) AS d, rank FROM hmr JOIN m USING (id) WHERE rank <= 40)"""
