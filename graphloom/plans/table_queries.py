"""Queries over the relational tables: graph views, windows, set operations, event windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import memory_id
from graphloom.plans.catalog import Catalog
from graphloom.sources import files, relational
from graphloom.sources.relational import STAR
from graphloom.session import table

catalog = Catalog()
_SCHEMA_SQL = ", ".join(
    f"('{t.name}', '{c}', {str(c == t.key).lower()}, {'NULL' if r is None else chr(39) + r + chr(39)})" for t in STAR for c, r in {t.key: None, **dict(t.foreign)}.items()
)
_KEYS = [(t.name, t.key) for t in STAR]


@catalog.query(" UNION ALL ".join(f"SELECT '{n}:' || {k} AS id, '{n}' AS type FROM {n}" for n, k in _KEYS))
def row_nodes(spark, sf_dir):
    return reduce(DataFrame.unionByName, [relational.row_nodes(table(spark, sf_dir, t.name), t) for t in STAR])


@catalog.query(
    " UNION ALL ".join(
        f"SELECT '{t.name}:' || {t.key} AS src, '{ref}:' || {c} AS dst, '{c}' AS relationship FROM {t.name} WHERE {c} IS NOT NULL" for t in STAR for c, ref in t.foreign
    )
    + " UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'l_partkey' FROM lineitem UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'supplier:' || l_suppkey, 'l_suppkey' FROM lineitem"
)
def fk_edges(spark, sf_dir):
    parts = [e for t in STAR if (e := relational.foreign_edges(table(spark, sf_dir, t.name), t)) is not None]
    lines = table(spark, sf_dir, "lineitem")
    for column, ref in (("l_partkey", "part"), ("l_suppkey", "supplier")):
        link = lines.select("l_orderkey", column).distinct()
        parts.append(
            link.select(
                F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("src"),
                F.concat(F.lit(f"{ref}:"), F.col(column).cast("string")).alias("dst"),
                F.lit(column).alias("relationship"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@catalog.query(
    "SELECT 'customer:' || c_custkey AS src, 'customer:c_mktsegment:' || c_mktsegment AS dst, 'c_mktsegment' AS relationship FROM customer WHERE c_mktsegment IS NOT NULL "
    "UNION ALL SELECT 'customer:' || c_custkey, 'customer:c_name:' || c_name, 'c_name' FROM customer WHERE c_name IS NOT NULL"
)
def column_value_edges(spark, sf_dir):
    customer = next(t for t in STAR if t.name == "customer")
    return relational.value_edges(table(spark, sf_dir, "customer"), customer, ["c_mktsegment", "c_name"])


@catalog.query(
    f"""WITH k(table_name, column_name, is_key, refers) AS (VALUES {_SCHEMA_SQL})
SELECT c.table_name, c.column_name, CASE c.data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(c.data_type) END AS type, coalesce(is_key, false) AS is_key, refers AS "references"
FROM information_schema.columns c LEFT JOIN k ON k.table_name = c.table_name AND k.column_name = c.column_name WHERE c.table_name IN ({', '.join(f"'{t.name}'" for t in STAR)})"""
)
def schema_nodes(spark, sf_dir):
    """The columns of every table with key and reference, as rows."""
    rows = relational.schema_rows({t.name: table(spark, sf_dir, t.name) for t in STAR})
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, is_key boolean, references string")


@catalog.query("SELECT 'orders' AS name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_refs FROM orders UNION ALL SELECT 'customer', count(*), count(DISTINCT c_nationkey) FROM customer")
def table_profile(spark, sf_dir):
    a = table(spark, sf_dir, "orders").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_refs")).withColumn("name", F.lit("orders"))
    b = table(spark, sf_dir, "customer").agg(F.count("*").alias("n_rows"), F.countDistinct("c_nationkey").alias("n_refs")).withColumn("name", F.lit("customer"))
    return a.unionByName(b).select("name", "n_rows", "n_refs")


@catalog.query("SELECT row_number() OVER (ORDER BY n_nationkey) AS row_no, 'Row ' || row_number() OVER (ORDER BY n_nationkey) || ':' || chr(10) || 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey AS text FROM nation")
def csv_rows(spark, sf_dir):
    return files.csv_text(table(spark, sf_dir, "nation"), ["n_nationkey"])


@catalog.query(
    """SELECT regexp_replace(regexp_replace(file_path, '/?[^/]*$', ''), '/', '.', 'g') AS dataset, count(DISTINCT file_path) AS n_files FROM source_files WHERE file_path IS NOT NULL GROUP BY 1"""
)
def datasets_by_directory(spark, sf_dir):
    rows = table(spark, sf_dir, "source_files").where("file_path is not null")
    return rows.groupBy(files.dataset_of(F.col("file_path")).alias("dataset")).agg(F.countDistinct("file_path").alias("n_files"))


@catalog.query(
    """SELECT CASE lower(regexp_extract(file_path, '\\.([^./]*)$', 1)) WHEN 'json' THEN 'text' WHEN 'xml' THEN 'text' WHEN 'yml' THEN 'text' ELSE 'unstructured' END AS kind,
count(*) AS n FROM source_files GROUP BY 1"""
)
def document_typing(spark, sf_dir):
    return table(spark, sf_dir, "source_files").groupBy(files.document_kind(F.coalesce("file_path", F.lit(""))).alias("kind")).agg(F.count("*").alias("n"))


@catalog.query("SELECT md5(text) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.groupBy(F.md5("text").alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@catalog.query(
    """WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(code, 'https?://[^\\s"''<>]+')) AS url FROM source_files WHERE code LIKE '%http%'), h AS (SELECT url, regexp_extract(url, 'https?://(?:[^/@]*@)?([^/:?#]+)', 1) AS host FROM u WHERE url <> '')
SELECT host, count(*) AS n_urls FROM h GROUP BY host"""
)
def url_hosts(spark, sf_dir):
    """The hosts of all URLs of every file, with the number of different URLs."""
    found = F.regexp_extract_all("code", F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))
    urls = table(spark, sf_dir, "source_files").where(F.col("code").contains("http")).select(F.explode(found).alias("url")).distinct()
    host = F.regexp_extract("url", r"https?://(?:[^/@]*@)?([^/:?#]+)", 1)
    return urls.groupBy(host.alias("host")).agg(F.count("*").alias("n_urls"))


@catalog.query("SELECT src, relationship_name, dst FROM (SELECT DISTINCT src, relationship_name, dst FROM memory_edges) ORDER BY src, relationship_name, dst LIMIT 25 OFFSET 50")
def triplet_page(spark, sf_dir):
    """One page of an ordered export of triplets."""
    rows = table(spark, sf_dir, "memory_edges").select("src", "relationship_name", "dst").distinct()
    return rows.orderBy("src", "relationship_name", "dst").offset(50).limit(25)


@catalog.query(
    """WITH t AS (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(replace(replace(lower('Episode:' || title), ' ', '_'), chr(39), ''))) AS h FROM documents WHERE title IS NOT NULL)
SELECT doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', (('0x' || h[17:17])::INT & 3) + 1, 1) || h[18:20], h[21:32]) AS episode_id FROM t"""
)
def deterministic_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("title is not null").select("doc_id", memory_id(F.concat(F.lit("Episode:"), "title")).alias("episode_id"))


# -- windows --------------------------------------------------------------------------
@catalog.query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1 AND event_type IN ('click', 'purchase')"""
)
def latest_run_per_group(spark, sf_dir):
    """The last run of each group; the filter on the status comes after the ranking."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.where(F.col("event_type").isin("click", "purchase")).select("user_id", "event_type", "event_id", "value")


@catalog.query(
    """WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT p_brand, p_partkey, p_retailprice, rank FROM r WHERE rank <= 4"""
)
def topk_per_parent(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("p_brand", "p_partkey", "p_retailprice", "rank")


@catalog.query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events")
def next_in_sequence(spark, sf_dir):
    """Each event flows to the user's next one, as a statement does to its successor."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lead("event_id").over(w).alias("next_id"))


# -- sets -----------------------------------------------------------------------------
@catalog.query(
    """SELECT kind, id, ts FROM (SELECT 'search' AS kind, event_id AS id, ts FROM events WHERE event_type = 'view'
UNION ALL SELECT 'run', event_id, ts FROM events WHERE event_type = 'purchase') ORDER BY ts DESC, id DESC LIMIT 20"""
)
def recent_activity(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    a = rows.where("event_type = 'view'").select(F.lit("search").alias("kind"), F.col("event_id").alias("id"), "ts")
    b = rows.where("event_type = 'purchase'").select(F.lit("run").alias("kind"), F.col("event_id").alias("id"), "ts")
    return a.unionByName(b).orderBy(F.desc("ts"), F.desc("id")).limit(20)


@catalog.query("SELECT user_id, event_type FROM events WHERE value > 50 UNION SELECT user_id, event_type FROM events WHERE event_type = 'error'")
def history_union(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.where("value > 50").select("user_id", "event_type").union(rows.where("event_type = 'error'").select("user_id", "event_type")).distinct()


@catalog.query(
    """(SELECT doc_id, 'unlabelled' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM quality_labels))
UNION ALL (SELECT doc_id, 'unknown' FROM (SELECT doc_id FROM quality_labels EXCEPT SELECT doc_id FROM documents))"""
)
def difference_both_ways(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "quality_labels").select("doc_id")
    return a.subtract(b).withColumn("side", F.lit("unlabelled")).unionByName(b.subtract(a).withColumn("side", F.lit("unknown")))


@catalog.query(
    """WITH r AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, relationship_name, edge_text, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst), relationship_name
ORDER BY src, edge_text NULLS LAST) AS rn FROM memory_edges) SELECT a, b, relationship_name, edge_text FROM r WHERE rn = 1"""
)
def edge_dedup(spark, sf_dir):
    """The first edge of each unordered pair and relation."""
    rows = table(spark, sf_dir, "memory_edges").withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    w = Window.partitionBy("a", "b", "relationship_name").orderBy("src", F.asc_nulls_last("edge_text"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("a", "b", "relationship_name", "edge_text")


# -- ranges -----------------------------------------------------------------------------
@catalog.query(
    """WITH r AS (SELECT user_id, date_trunc('day', ts) AS day, epoch_us(min(ts)) AS c0, epoch_us(max(ts)) AS c1 FROM events GROUP BY 1, 2),
q AS (SELECT * FROM (VALUES (1, 1704412800000000, 1704499200000000), (2, 1705276800000000, 1705881600000000)) t(query_id, q0, q1))
SELECT query_id, user_id, day, least(c1, q1) - greatest(c0, q0) AS common_us FROM r JOIN q ON c0 < q1 AND c1 > q0"""
)
def overlap_join(spark, sf_dir):
    """Ranges of activity that overlap one of the asked ranges; the asked ranges are a literal of two rows, so they are broadcast."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.unix_micros(F.min("ts").cast("timestamp")).alias("c0"), F.unix_micros(F.max("ts").cast("timestamp")).alias("c1")
    )
    asked = spark.createDataFrame(
        [(1, 1704412800000000, 1704499200000000), (2, 1705276800000000, 1705881600000000)], "query_id int, q0 long, q1 long"
    )
    hits = rows.join(F.broadcast(asked), (F.col("c0") < F.col("q1")) & (F.col("c1") > F.col("q0")))
    return hits.select("query_id", "user_id", "day", (F.least("c1", "q1") - F.greatest("c0", "q0")).alias("common_us"))


@catalog.query(
    """WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
t AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM c WHERE n > 0) SELECT c_custkey, n, round(greatest(12, q3 + 1.5 * (q3 - q1)), 6) AS threshold FROM c, t WHERE n > greatest(12, q3 + 1.5 * (q3 - q1)) OR n > 25"""
)
def oversize_detection(spark, sf_dir):
    """Groups beyond the third quartile by 1.5 interquartile ranges, 12 at least, or beyond 25."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    counts = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    q = counts.where("n > 0").agg(F.percentile("n", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    limit = q.select(F.greatest(F.lit(12.0), F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("threshold"))
    return counts.crossJoin(limit).where("n > threshold or n > 25").select("c_custkey", "n", F.round("threshold", 6).alias("threshold"))  # one row


@catalog.query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@catalog.query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6 hours' THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no"""
)
def events_session(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    sessions = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("s.start").alias("start"), "n")


@catalog.query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 90")
def json_property_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k > 90")


@catalog.query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


QUERIES, ORACLE = catalog.queries, catalog.oracle
