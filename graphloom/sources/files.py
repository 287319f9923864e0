"""Files as tables: scanning by extension, decoding with fallbacks, CSV rows as text, data sets by directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

#: What kind of document an extension stands for.
DOCUMENT_KINDS = {
    "txt": "text", "md": "text", "json": "text", "xml": "text", "yaml": "text", "yml": "text", "log": "text", "csv": "csv", "pdf": "pdf",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "mp3": "audio", "wav": "audio", "docx": "unstructured", "html": "unstructured",
}
_LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def use_loader(extension: str, load: Callable[[SparkSession, str], DataFrame]) -> None:
    """Register how files of an extension are read; the last registration counts."""
    _LOADERS[extension.lower()] = load


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files at ``path``, by the loader of their extension, else as text."""
    extension = path.rsplit(".", 1)[-1].lower()
    return _LOADERS.get(extension, read_text)(spark, path)


def scan(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """(path, length, content) of all files below a folder with one of the extensions."""
    glob = "*.{" + ",".join(extensions) + "}"
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "content")
    )


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", decode(F.col("content")).alias("text"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``row_no``, counting from 1 in the given order.

    The rows are sorted by ranges and numbered within each; the sizes of the ranges
    before, one number each, are added. So no task sees all rows.
    """
    from pyspark.sql import Window

    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_local", local).join(before, "_p").select(*rows.columns, (F.col("_local") + F.col("_before")).alias("row_no"))


def csv_text(rows: DataFrame, order: list[str]) -> DataFrame:
    """(row_no, text): each row as ``Row i:`` and ``name: value`` pairs; nulls are left out."""
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in rows.columns]
    text = F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(":\n"), F.concat_ws(", ", *pairs))
    return numbered(rows, order).select("row_no", text.alias("text"))


def dataset_of(path: Column) -> Column:
    """The data set of a file: its directories joined by dots; empty for files in the root."""
    return F.regexp_replace(F.regexp_replace(path, r"/?[^/]*$", ""), "/", ".")


def document_kind(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in DOCUMENT_KINDS.items() for x in kv])
    return F.coalesce(kinds[F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))], F.lit("unstructured"))


def path_after(base: str, url: Column) -> Column:
    """The path of a URL after that of a base; null on another host, the full path if the base is no prefix."""
    b = F.lit(base)
    base_path, path = F.rtrim(F.coalesce(F.try_parse_url(b, F.lit("PATH")), F.lit("")), F.lit("/")), F.try_parse_url(url, F.lit("PATH"))
    same = F.try_parse_url(url, F.lit("HOST")) == F.try_parse_url(b, F.lit("HOST"))
    return F.when(same, F.when(path.startswith(base_path), F.substr(path, F.length(base_path) + 1)).otherwise(path))


def openapi_endpoints(specs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(file, endpoint, method, operation_id): one row per path and method of JSON interface descriptions.

    Texts that aren't such a description give no row; keys of a path that aren't methods are left out.
    """
    methods = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
    paths = F.from_json(F.get_json_object(text_col, "$.paths"), "map<string,map<string,string>>")
    routes = specs.select(F.col(path_col).alias("file"), F.explode(paths).alias("endpoint", "operations"))
    calls = routes.select("file", "endpoint", F.explode("operations").alias("method", "body")).where(F.lower("method").isin(*methods))
    return calls.select("file", "endpoint", F.upper("method").alias("method"), F.get_json_object("body", "$.operationId").alias("operation_id"))


def media(spark: SparkSession, path: str, transcripts: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, length, text) of images or sound below a folder, with the texts (path, text) that a model outside made; null without one."""
    found = scan(spark, path, extensions).select("path", "length")
    return found.join(transcripts.select("path", "text"), "path", "left")


def classify_input(value: Column) -> Column:
    """What a caller handed over: url, s3, file (a path with an extension), or text."""
    return (
        F.when(value.rlike(r"(?i)^\s*https?://\S+\s*$"), "url")
        .when(value.rlike(r"(?i)^\s*s3a?://\S+\s*$"), "s3")
        .when(value.rlike(r"^\s*(?:file://)?(?:[~.]{0,2}/)?[\w.-]+(?:/[\w.-]+)*\.\w{1,8}\s*$"), "file")
        .otherwise("text")
    )


def html_text(html: Column) -> Column:
    """The text of a page: without scripts, styles and tags, blocks on lines of their own, the common entities as characters."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/?(?:p|div|li|tr|h[1-6]|section|article|table|ul|ol))\b[^<>]*>", "\n")
    t = F.regexp_replace(t, r"<[^<>]*>", "")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def pages(rows: DataFrame, rules: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of fetched pages (url, html): a node per page with its text, one per site, an edge from page to site.

    ``rules`` tells which pages may be used; fetching itself is up to the caller.
    """
    kept = rows if rules is None else rows.where(rules)
    p = kept.select("url", html_text(F.col("html")).alias("text"), F.try_parse_url("url", F.lit("HOST")).alias("host")).where("host is not null").dropDuplicates(["url"])
    nodes = p.select(F.col("url").alias("id"), F.lit("WebPage").alias("node_type"), "text").unionByName(
        p.select(F.col("host").alias("id"), F.lit("WebSite").alias("node_type"), F.lit(None).cast("string").alias("text")).distinct()
    )
    return nodes, p.select(F.col("url").alias("src"), F.col("host").alias("dst"), F.lit("is_part_of").alias("relationship_name"))


def lsif(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a language-server index in JSON lines: documents and ranges, and what contains what or follows."""
    rows = spark.read.json(path, schema="id string, type string, label string, uri string, outV string, inV string, inVs array<string>, start struct<line:int,character:int>, `end` struct<line:int,character:int>")
    nodes = rows.where("type = 'vertex' and id is not null").select("id", F.col("label").alias("node_type"), F.col("uri").alias("file_path"), (F.col("start.line") + 1).alias("line_start"), (F.col("end.line") + 1).alias("line_end"))
    ends = F.coalesce("inVs", F.array("inV"))
    edges = rows.where("type = 'edge' and outV is not null").select(F.col("outV").alias("src"), F.explode(ends).alias("dst"), F.upper("label").alias("edge_type"))
    return nodes, edges.where("dst is not null")
