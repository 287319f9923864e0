"""Groups of texts that are one text apart from small edits.

A text becomes the set of its token sequences of length ``gram`` (comments and
layout left out). Two texts are linked if the Jaccard similarity of their sets
reaches ``threshold``.

Candidates come from token-combination prefixes. The elements of a set are
ordered from rare to frequent in the whole collection. Two similar sets share at
least two elements within their extended prefixes, which are one element longer
than the usual prefix of a similarity join. Rare elements of such a prefix are
indexed one by one, frequent ones only as pairs: if none of the shared elements
is rare, two frequent ones are shared, so a pair of them meets. Each candidate is
then verified on the whole sets. Elements that one text alone has count in the
prefix, but are never indexed; most texts without a partner end there.

A set of one element can share no more than that: such sets meet sets of two by
their one element, which makes as many rows as there are results.

Copies of one text are collapsed to one class before, so a large group of copies
costs one row in the join. An element that very many texts hold is counted by a
partial aggregation, and its rows are spread over the tasks; which elements these
are is guessed from a share of the texts, which changes where rows go, but no count
and no result. ``similar_pairs`` expands groups of copies to all their pairs;
``similar_groups`` gives one row per record and is what scales.

Defined results for odd input
-----------------------------
* A row whose id or text is null is ignored; of rows with one id the last loaded
  counts (then the greatest text), so repeated rows count once.
* A text without tokens (empty, blank, comments only) is linked to nothing.
* A text of fewer than ``gram`` tokens is one sequence, so only copies link to it.
* Texts of any length are compared whole. Other columns are dropped.
* Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import components
from graphloom.session import cut_lineage

COMMENT = r"(?s:/\*.*?\*/)|//[^\n]*|#[^\n]*"
TOKEN = r"\w+|[^\w\s]"


def sequences(text: Column, gram: int) -> Column:
    """The distinct hashed token sequences of a text."""
    tokens = F.regexp_extract_all(F.regexp_replace(text, COMMENT, " "), F.lit(TOKEN), 0)

    def of(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(0), F.greatest(n - gram, F.lit(0)))
        runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]))
        return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    # a one-element array binds the tokens, so that they are extracted once
    return F.transform(F.array(tokens), of)[0]


def _rows(records: DataFrame, id_col: str, text_col: str, order_col: str | None) -> DataFrame:
    order = F.col(order_col).cast("string") if order_col else F.lit("")
    kept = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    squeezed = F.regexp_replace(text_col, rf"{COMMENT}|\s+", "")
    return kept.select(
        F.col(id_col).alias("id"),
        F.coalesce(order, F.lit("")).alias("loaded"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.md5(squeezed)).alias("h"),
    )


def _frequent(classes: DataFrame, each: DataFrame, gram: int, hot_rows: int, share: int) -> DataFrame:
    """(g, total) of elements that about ``hot_rows`` classes or more hold, 100,000 at most, counted over all classes.

    The guess reads one class of ``share`` (by hash); an element that it misses is counted like any other.
    """
    some = classes.where(F.pmod("h", F.lit(share)) == 0).select(F.explode(sequences(F.col("text"), gram)).alias("g"))
    many = some.groupBy("g").agg(F.count("*").alias("seen")).where(F.col("seen") * share >= hot_rows)
    hot = cut_lineage(many.orderBy(F.desc("seen"), "g").limit(100_000).select("g"))
    return each.join(F.broadcast(hot), "g", "left_semi").groupBy("g").agg(F.count("*").alias("total"))


def link_classes(
    rows: DataFrame, *, threshold: float = 0.5, gram: int = 4, rare: int = 32, extend: int = 1, hot_rows: int = 200_000, share: int = 64
) -> DataFrame:
    """(h_a, h_b, similarity) of the classes of copies that are similar, h_a < h_b.

    ``rows`` has a class ``h`` and its ``text``. An element in at most ``rare``
    classes, or in fewer than half as many as the set has elements, is indexed alone.
    """
    classes = rows.groupBy("h").agg(F.max("text").alias("text"))
    grams = classes.select("h", sequences(F.col("text"), gram).alias("grams"))
    each = grams.select("h", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    hot = _frequent(classes, each, gram, hot_rows, share)
    spread = F.when(F.col("total").isNotNull(), F.pmod("h", F.lit(1024))).otherwise(0).cast("short")
    salted = each.join(F.broadcast(hot), "g", "left").withColumn("salt", spread)
    # one exchange serves the count and the rows it counts
    counted = salted.withColumn("df", F.coalesce("total", F.count("*").over(Window.partitionBy("g", "salt")))).where("df > 1")
    prefix = F.col("n") - F.ceil(F.col("n") * threshold) + 1 + extend
    sets = (
        counted.groupBy("h")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "g"))).alias("items"))
        .withColumn("indexed", (prefix - (F.col("n") - F.size("items"))).cast("int"))
        .where("indexed > 0")
    )
    sets = cut_lineage(sets)
    head = sets.select("h", "n", F.slice("items", 1, F.col("indexed")).alias("head"))
    # similar sets differ in size by the threshold at most: with these two bounds, an element that two of them share is
    # indexed alone in both or takes part in pairs in both, and long sets make few pairs
    alone = head.select("h", "n", F.explode("head").alias("x")).where(f"x.df <= greatest({rare}, n / 2)").select(
        "h", "n", F.col("x.g").alias("sig")
    )
    frequent = F.filter("head", lambda x: x.df > F.greatest(F.lit(rare), F.col("n") * threshold / 2))
    often = head.select("h", "n", F.array_sort(F.transform(frequent, lambda x: x.g)).alias("often")).where("size(often) > 1")
    paired = often.select("h", "n", "often", F.posexplode("often").alias("at", "first")).select(
        "h",
        "n",
        F.explode(F.slice("often", F.col("at") + 2, F.size("often"))).alias("second"),
        "first",
    ).select("h", "n", F.xxhash64("first", "second").alias("sig"))
    index = alone.unionByName(paired)
    left = index.select("sig", F.col("h").alias("h_a"), F.col("n").alias("n_a"))
    right = index.select("sig", F.col("h").alias("h_b"), F.col("n").alias("n_b"))
    fits = (F.col("h_a") < F.col("h_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    met = left.join(right, "sig").where(fits).select("h_a", "h_b")
    # the one element of a set may be frequent
    tiny = sets.where("n <= 2").select("h", "n", F.explode("items.g").alias("sig"))
    one = tiny.where("n = 1").select("sig", F.col("h").alias("x"))
    two = tiny.select("sig", F.col("h").alias("y"))
    by_one = one.join(two, "sig").where("x <> y").select(F.least("x", "y").alias("h_a"), F.greatest("x", "y").alias("h_b"))
    pairs = met.unionByName(by_one).distinct()
    whole = sets.select("h", "n", F.transform("items", lambda x: x.g).alias("s"))
    a = whole.select(F.col("h").alias("h_a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    b = whole.select(F.col("h").alias("h_b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return (
        pairs.join(a, "h_a")
        .join(b, "h_b")
        .select("h_a", "h_b", "n_a", "n_b", shared.alias("shared"))
        .withColumn("similarity", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
        .where(F.col("similarity") >= threshold)
        .select("h_a", "h_b", "similarity")
    )


def members(rows: DataFrame) -> DataFrame:
    """(id, h): the class of each record, by its last loaded row."""
    last = rows.groupBy("id").agg(F.max(F.struct("loaded", F.md5("text"), "h")).alias("last"))
    return last.select("id", "last.h")


def similar_pairs(
    records: DataFrame, *, id_col: str = "id", text_col: str = "code", order_col: str | None = "loaded_at", **options
) -> DataFrame:
    """(id_a, id_b) of all records that are alike, id_a < id_b, copies expanded."""
    rows = _rows(records, id_col, text_col, order_col)
    links = link_classes(rows, **options)
    known = members(rows.where(F.trim(F.regexp_replace("text", COMMENT, "")) != ""))
    a = known.select(F.col("id").alias("x"), F.col("h").alias("h_a"))
    b = known.select(F.col("id").alias("y"), F.col("h").alias("h_b"))
    across = links.join(a, "h_a").join(b, "h_b").select("x", "y")
    within = a.join(b, a.h_a == b.h_b).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_groups(
    records: DataFrame, *, id_col: str = "id", text_col: str = "code", order_col: str | None = "loaded_at", **options
) -> DataFrame:
    """(id, class_id, group_id, n_links), one row per record.

    ``class_id`` is the smallest id among copies of the text, ``group_id`` the
    smallest ``class_id`` that links lead to, ``n_links`` the number of other
    classes that this one is linked to directly.
    """
    rows = _rows(records, id_col, text_col, order_col)
    known = cut_lineage(members(rows))
    names = known.groupBy("h").agg(F.min("id").alias("class_id"))
    links = cut_lineage(link_classes(rows, **options))
    a = names.select(F.col("h").alias("h_a"), F.col("class_id").alias("a"))
    b = names.select(F.col("h").alias("h_b"), F.col("class_id").alias("b"))
    named = cut_lineage(links.join(a, "h_a").join(b, "h_b").select("a", "b"))
    degree = (
        named.select(F.col("a").alias("class_id"))
        .union(named.select("b"))
        .groupBy("class_id")
        .agg(F.count("*").alias("n_links"))
    )
    groups = components(named).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    return (
        known.join(names, "h")
        .join(degree, "class_id", "left")
        .join(groups, "class_id", "left")
        .select(
            "id",
            "class_id",
            F.coalesce("group_id", "class_id").alias("group_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
