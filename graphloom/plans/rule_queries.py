"""Queries of rules over texts: triggers, classes, worth, sensitivity, questions, contradictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.plans.catalog import MEMORY_SQL, Catalog
from graphloom.sources.graph_tables import memory_nodes
from graphloom.session import table

catalog = Catalog()
_T = "(SELECT doc_id, dataset_id, text FROM documents WHERE text IS NOT NULL)"


def _texts(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", *columns)


@catalog.query(
    f"""WITH x AS (SELECT doc_id, text, coalesce(lag(text) OVER (PARTITION BY dataset_id ORDER BY doc_id), '') AS before FROM {_T})
SELECT doc_id, {rules.trigger_sql('text', 'before')} AS reason FROM x"""
)
def procedural_trigger(spark, sf_dir):
    """Whether a message asks for a procedure; the text before it in its dataset is taken for the answer before."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("dataset_id").orderBy("doc_id")), F.lit(""))
    rows = _texts(spark, sf_dir, "dataset_id").withColumn("before", before)
    return rows.select("doc_id", rules.trigger(F.col("text"), F.col("before")).alias("reason"))


_SCORE, _KIND = rules.procedural_sql("text")


@catalog.query(
    f"""WITH x AS (SELECT doc_id, text, {_SCORE} AS score FROM {_T}), y AS (SELECT *, {_KIND} AS kind FROM x)
SELECT doc_id, score, kind, round(CASE WHEN length(trim(text)) < 20 THEN 0.9 WHEN kind = 'procedural' THEN least(0.9, 0.5 + score) WHEN kind = 'likely' THEN 0.4 + score * 0.5 WHEN kind = 'factual' THEN 0.5 ELSE 0.6 - score END + 1e-9, 2) AS confidence FROM y"""
)
def procedural_class(spark, sf_dir):
    text, score, kind = F.col("text"), F.col("score"), F.col("kind")
    rows = _texts(spark, sf_dir).withColumn("score", rules.procedural_score(text)).withColumn("kind", rules.procedural_kind(text, score))
    return rows.select("doc_id", "score", "kind", rules.procedural_confidence(kind, text, score).alias("confidence"))


_STEPS = "len(regexp_extract_all(text, '(?:^|\\n)\\s*[1-9][.)]'))"


@catalog.query(
    f"""WITH x AS (SELECT doc_id, {rules.worth_sql('text', _STEPS, "contains(text, 'because') AND contains(text, 'when')")} AS worth FROM {_T})
SELECT doc_id, worth, CASE WHEN worth >= 0.4 THEN 'full' WHEN worth >= 0.2 THEN 'summary_only' ELSE 'none' END AS index_level FROM x"""
)
def procedure_worth(spark, sf_dir):
    text = F.col("text")
    steps = F.size(F.regexp_extract_all(text, F.lit(r"((?:^|\n)\s*[1-9][.)])"), 1))
    complete = F.contains(text, F.lit("because")) & F.contains(text, F.lit("when"))
    rows = _texts(spark, sf_dir).select("doc_id", rules.worth(text, steps, complete).alias("worth"))
    return rows.withColumn("index_level", rules.index_level(F.col("worth")))


@catalog.query(f"SELECT doc_id, {rules.sensitivity_sql('text')} AS level FROM {_T}")
def sensitivity(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", rules.sensitivity(F.col("text")).alias("level"))


@catalog.query(f"SELECT doc_id, {rules.redact_sql('text')} AS text, contains({rules.redact_sql('text')}, '[REDACTED_') AS redacted FROM {_T}")
def redact_secrets(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", rules.redact(F.col("text")).alias("text"))
    return rows.withColumn("redacted", F.contains("text", F.lit("[REDACTED_")))


@catalog.query("SELECT file_id, md5(c) AS digest, contains(c, '[REDACTED_') AS redacted FROM (SELECT DISTINCT file_id, " + rules.redact_sql("code") + " AS c FROM source_files WHERE code IS NOT NULL)")
def redact_source_files(spark, sf_dir):
    """The ordered rules over program texts, which hold what they look for."""
    rows = table(spark, sf_dir, "source_files").where("code is not null").select("file_id", rules.redact(F.col("code")).alias("c")).distinct()
    return rows.select("file_id", F.md5("c").alias("digest"), F.contains("c", F.lit("[REDACTED_")).alias("redacted"))


@catalog.query(
    f"SELECT doc_id, {rules.any_of_sql('text', rules.DANGEROUS)} AS dangerous, {rules.any_of_sql('text', rules.RISKY)} AS risky, {rules.any_of_sql('text', rules.TIME_HINTS)} AS time_hint FROM {_T}"
)
def safety_flags(spark, sf_dir):
    text = F.col("text")
    return _texts(spark, sf_dir).select(
        "doc_id",
        rules.any_of(text, rules.DANGEROUS).alias("dangerous"),
        rules.any_of(text, rules.RISKY).alias("risky"),
        rules.any_of(text, rules.TIME_HINTS).alias("time_hint"),
    )


_VECTOR, _REASON, _KEYWORD = rules.question_sql("t")


@catalog.query(
    f"""WITH x AS (SELECT doc_id, substr(text, 1, 40) AS t FROM {_T}), y AS (SELECT *, {_REASON} AS reason FROM x)
SELECT doc_id, {_VECTOR} AS vector_query, reason, {_KEYWORD} AS keyword, CASE WHEN regexp_matches(t, '\\d{{4}}') THEN least(10 * 2, 300) ELSE 10 END AS wide_k FROM y"""
)
def question_parts(spark, sf_dir):
    """How a question is prepared for search, the first 40 characters of each text being the question."""
    t, reason = F.col("t"), F.col("reason")
    rows = _texts(spark, sf_dir).select("doc_id", F.substring("text", 1, 40).alias("t")).withColumn("reason", rules.hybrid_reason(t))
    wide = F.when(t.rlike(r"\d{4}"), F.least(F.lit(10 * 2), F.lit(300))).otherwise(10)
    return rows.select("doc_id", rules.vector_query(t).alias("vector_query"), "reason", rules.keyword(t, reason).alias("keyword"), wide.alias("wide_k"))


_PAIRS = f"""{MEMORY_SQL}, v AS (SELECT dataset_id, node_type, id, coalesce(aliases, []) AS steps, coalesce(description, '') AS text,
lag(coalesce(aliases, [])) OVER w AS old_steps, lag(coalesce(description, '')) OVER w AS old_text, row_number() OVER w AS version FROM m WHERE node_type = 'Facet' WINDOW w AS (PARTITION BY dataset_id ORDER BY created_at NULLS FIRST, id))"""


def _versions(spark, sf_dir):
    """Facets of a dataset by age as versions of one procedure, each with the one before; their aliases stand for steps."""
    rows = memory_nodes(spark, sf_dir).where("node_type = 'Facet'")
    steps, text = F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("description", F.lit(""))
    w = Window.partitionBy("dataset_id").orderBy(F.asc_nulls_first("created_at"), "id")
    rows = rows.select("dataset_id", "created_at", "id", steps.alias("steps"), text.alias("text"))
    rows = rows.withColumns({"old_steps": F.lag("steps").over(w), "old_text": F.lag("text").over(w), "version": F.row_number().over(w)})
    return rows.where("old_steps is not null")


@catalog.query(
    f"""WITH {_PAIRS}, s AS (SELECT id, {rules.conflict_sql('old_steps', 'steps', 'text', 'old_text', 'text')} AS score FROM v WHERE old_steps IS NOT NULL)
SELECT id, score, CASE WHEN score >= 0.7 THEN 'new_version' WHEN score >= 0.3 THEN 'mild' ELSE 'none' END AS level FROM s"""
)
def version_conflicts(spark, sf_dir):
    c = F.col
    rows = _versions(spark, sf_dir).select("id", rules.conflict(c("old_steps"), c("steps"), c("text"), c("old_text"), c("text")).alias("score"))
    return rows.withColumn("level", rules.conflict_level(F.col("score")))


@catalog.query(
    f"""WITH {_PAIRS} SELECT id, version, len(list_filter(list_distinct(steps), lambda x: NOT list_contains(old_steps, x))) AS n_added, len(list_filter(list_distinct(old_steps), lambda x: NOT list_contains(steps, x))) AS n_removed,
len(list_filter(list_distinct(steps), lambda x: list_contains(old_steps, x) AND list_position(old_steps, x) <> list_position(steps, x))) AS n_reordered, text <> old_text AS text_changed FROM v WHERE old_steps IS NOT NULL"""
)
def version_diff(spark, sf_dir):
    """Steps that a version adds, removes and moves against the one before."""
    moved = F.filter(
        F.array_intersect("steps", "old_steps"), lambda x: F.array_position("old_steps", x) != F.array_position("steps", x)
    )
    return _versions(spark, sf_dir).select(
        "id",
        "version",
        F.size(F.array_except("steps", "old_steps")).alias("n_added"),
        F.size(F.array_except("old_steps", "steps")).alias("n_removed"),
        F.size(moved).alias("n_reordered"),
        (F.col("text") != F.col("old_text")).alias("text_changed"),
    )


QUERIES, ORACLE = catalog.queries, catalog.oracle
