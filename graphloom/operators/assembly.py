"""From scored bundles to what a recall returns: bonuses, sections, sorted edges, budgets, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units that belong to the number before them.
UNITS = "分钟|小时|个月|个小时|个星期|个周|万|亿|TB|GB|MB|KB|次|条|人|家|天|月|年|元|%|个|分|秒"
_UNIT = rf"(?i)([0-9]+\.?[0-9]*)\s*({UNITS})"
FULL, PARTIAL, LATIN, KEYWORD = 0.12, 0.03, 0.08, 0.15


def number_tokens(text: Column) -> tuple[Column, Column]:
    """(with units, alone): the numbers of a text; the first as number and unit without blanks, in lower case."""
    united = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)([0-9]+\.?[0-9]*\s*(?:{UNITS}))"), 1), lambda x: F.lower(F.regexp_replace(x, r"\s", "")))
    alone = F.regexp_extract_all(F.regexp_replace(text, _UNIT, " "), F.lit(r"\b([0-9]+\.?[0-9]*)\b"), 1)
    return united, alone


def exact_bonus(question: Column, text: Column) -> Column:
    """What numbers, and Latin words of a mixed question, take from a distance: a value of 0 or below.

    Each different number of the question counts once: fully if the text has it with
    the same unit, partly if only the digits are equal.
    """
    qu, qa = number_tokens(question)
    tu, ta = number_tokens(text)
    asked, known = F.array_distinct(F.concat(qu, qa)), F.concat(tu, ta)
    digits = F.transform(known, lambda x: F.regexp_extract(x, r"^([0-9]+\.?[0-9]*)", 1))
    full = F.size(F.filter(asked, lambda x: F.array_contains(known, x)))
    part = F.size(F.filter(asked, lambda x: ~F.array_contains(known, x) & F.array_contains(digits, F.regexp_extract(x, r"^([0-9]+\.?[0-9]*)", 1))))
    latin = r"([A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]|[A-Za-z]{2,})"
    words = F.size(F.array_intersect(F.regexp_extract_all(F.lower(question), F.lit(latin), 1), F.regexp_extract_all(F.lower(text), F.lit(latin), 1)))
    mixed = F.when(question.rlike("[一-鿿]"), F.least(words * LATIN, F.lit(2 * LATIN))).otherwise(0.0)
    return -F.least(full * FULL + part * PARTIAL, F.lit(2 * FULL)) - mixed


def with_exact_bonus(score: Column, question: Column, text: Column) -> Column:
    """The distance less the bonus, at least 0; near hits (under 0.1) stay as they are."""
    return F.when(score >= 0.1, F.greatest(F.lit(0.0), score + exact_bonus(question, text))).otherwise(score)


def with_keyword_bonus(score: Column, keyword: Column, text: Column) -> Column:
    """The distance less the bonus if the text holds the keyword, blanks and case aside."""
    squeezed = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.when((keyword != "") & F.contains(squeezed, F.regexp_replace(F.lower(keyword), r"\s+", "")), F.greatest(F.lit(0.0), score - KEYWORD)).otherwise(score)


def with_time_bonus(score: Column, bonus: Column, penalty: Column | None = None, floor: float = 0.08) -> Column:
    out = F.greatest(F.lit(floor), score - bonus)
    return out if penalty is None else out + penalty


def keep_sections(summary: Column, names: Column) -> Column:
    """The 【title】body sections whose title is one of the names, or the whole summary if none is."""
    titles = F.regexp_extract_all(summary, F.lit("【([^】]*)】[^【]*"), 1)
    whole = F.regexp_extract_all(summary, F.lit("(【[^】]*】[^【]*)"), 1)
    low = F.transform(names, lambda n: F.lower(F.trim(n)))
    kept = F.filter(whole, lambda s, k: F.array_contains(low, F.lower(F.trim(F.get(titles, k)))))
    return F.when(F.size(kept) > 0, F.trim(F.array_join(F.transform(kept, lambda x: F.trim(x)), " "))).otherwise(summary)


#: The order of relations in a result.
RELATIONS = ("has_point", "has_facet", "involves_entity")


def sort_edges(edges: DataFrame, by: str) -> DataFrame:
    """The edges with their position: basic by episode rank, node cost less time effect, edge cost, relation and ids; adaptive by final score less time effect, relation and ids.

    A result is one recall's, bounded by its budgets, so one window sorts it.
    """
    order = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relationship_name"))
    order = F.when(order == 0, 9).otherwise(order)
    if by == "basic":
        keys = [F.col("episode_rank"), F.round(F.least("src_cost", "dst_cost") - F.col("time_effect"), 9), F.col("edge_cost"), order]
    else:
        keys = [F.round(F.greatest(F.lit(0.08), F.col("final") - F.col("time_effect")), 9), order]
    w = Window.partitionBy("query_id").orderBy(*keys, "src", "dst")
    return edges.withColumn("position", F.row_number().over(w))


def fold_packs(packs: DataFrame, points: DataFrame, direct: DataFrame) -> DataFrame:
    """(procedure, point, via): two steps over a pack as one, unless there is a direct edge."""
    two = packs.join(points, "pack").select("procedure", "point", F.lit("pack").alias("via")).distinct()
    own = direct.select("procedure", "point", F.lit("direct").alias("via")).distinct()
    return own.unionByName(two.join(own.select("procedure", "point"), ["procedure", "point"], "left_anti"))


def budgets(hits: DataFrame, kind: str, limits: dict[str, int]) -> DataFrame:
    """The best hits of each kind within its budget; kinds without a budget give nothing."""
    w = Window.partitionBy("query_id", kind).orderBy("d", "id")
    allowed = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= allowed[F.col(kind)])


def best_of_queries(hits: DataFrame, weights: dict[int, float], most: int) -> DataFrame:
    """(id, score, queries): each id's best distance over queries, divided by their weights; the first ``most``."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    scored = hits.withColumn("s", F.round(F.col("d") / weight[F.col("query_id")], 9))
    return scored.groupBy("id").agg(F.min("s").alias("score"), F.count_distinct("query_id").alias("queries")).orderBy("score", "id").limit(most)


def route(ranks: DataFrame, most: int = 5, summary_limit: int = 3, facet_limit: int = 5) -> DataFrame:
    """(query_id, episode, rank, merges) of the candidate episodes: the smallest rank over the sources.

    ``ranks`` has query_id, episode, source (summary, facet) and rank. A candidate
    takes a document in if both of its ranks are small.
    """
    g = ranks.groupBy("query_id", "episode").agg(
        F.min("rank").alias("best"), F.min(F.when(F.col("source") == "summary", F.col("rank"))).alias("s"), F.min(F.when(F.col("source") == "facet", F.col("rank"))).alias("f")
    )
    w = Window.partitionBy("query_id").orderBy("best", "episode")
    merges = F.coalesce((F.col("s") <= summary_limit) & (F.col("f") <= facet_limit), F.lit(False))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "episode", "rank", merges.alias("merges"))
