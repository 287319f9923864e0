"""Where source files come from: hand-written, generated, minified, third-party or data.

The directory tree of every project is hashed bottom-up (a Merkle tree): the hash
of a file is that of its text without comments and layout, the hash of a directory
a sum over its children. A subtree of several files that several projects hold is
vendored code, whatever its name and place, and decides all files below it; files
outside of such subtrees are decided by their own hash. Notices at the head of a
file and its layout (the lines of minified scripts, of number tables, of encoded
bytes) tell the rest, as do directories that are meant for foreign code. A banner
with a name and version is a notice of foreign code unless the project has that
name; a licence or copyright line is none, as hand-written files have them, too.

The sums of directories add up, so the sum of a directory is that of the files
below it: each file gives its four 32-bit words to all its directories, and one
aggregation with partial sums before the shuffle hashes all levels at once. It
needs no list of members, and a directory of any size is one row of sums a task.

Defined results for odd input
-----------------------------
* Null, empty and blank code and code of comments only is ``empty``; settings
  (json, xml, yaml, properties, dotenv, by extension) are ``config``; code that
  doesn't parse is ``invalid``. None of these counts as foreign.
* A null project or path counts as an empty string. Repeated rows of a file are
  one; of rows of one id that differ the first class in the order third-party,
  generated, minified, data, hand-written, config, empty, invalid holds.
* Texts of any length are read whole. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.syntax import files as checks
from graphloom.llm.syntax_errors import language_of
from graphloom.session import cut_lineage

CODE = ("python", "java", "javascript")
#: Directories that hold foreign code by convention.
FOREIGN_DIRS = (
    "vendor vendored third_party third-party thirdparty 3rdparty node_modules bower_components external externals extern "
    "site-packages dist-packages"
).split()
# leading comments and blank lines, in Python with the module's docstring; possessive, as Java's other repeats recurse
_REMARK = r"(?:[ \t]*+(?:(?s:/\*.*?\*/)|#|//|/\*|\*|@|package |<!--)[^\n]*+(?:\n|$)|[ \t\r]*+\n)"
_DOCSTRING = r"(?:[rRuU]?+(?:(?s:\"\"\".*?\"\"\"|'''.*?''')|\"[^\"\n]++\"|'[^'\n]++')[^\n]*+(?:\n|$))"
_HEAD = rf"^\x{{FEFF}}?{_REMARK}++"
_PYTHON_HEAD = rf"^\x{{FEFF}}?{_REMARK}*+{_DOCSTRING}?+{_REMARK}*+"
_GENERATED = (
    r"(?im)@generated\b|\bauto-?generated\b(?! method)"
    r"|\b(?:code|file|source|sources|class|module|output)(?: is| was| has been)?(?: automatically| auto)? ?"
    r"(?:generated|produced|emitted|created) (?:by|from)\b"
    r"|^\W*(?:automatically )?(?:generated|emitted|produced|created)(?: automatically)? (?:by|from) (?:the )?[\w.-]+"
    r"|do not (?:edit|modify)\s*(?:[.:!;]|by hand|manually|$)|output of the [\w ]*(?:compiler|generator)"
    r"|(?:edits|changes)(?: are| will be| to this file)? (?:overwritten|lost)|@(?:[\w.]+\.)?Generated\s*\("
)
_THIRD = (
    r"(?im)^\W*(?:upstream|origin)\s*:\s*https?://|\bvendored (?:from|copy)\b|\bcopied from https?://"
    r"|^\W*this (?:file|module|copy) (?:was|is) (?:copied|taken|imported) from\b"
)
_BANNER = r"(?m)^(?:/\*!|#|//|\*|/\*)[ \t]*+([\w.-]++)[ \t]++v?\d++\.\d++(?:\.\d++)?+[ \t\r]*+$"
_NUMBER = r"-?(?:0[xX][0-9A-Fa-f]++|\d++(?:\.\d++)?+(?:[eE][-+]?+\d++)?+)[lLfFdD]?+"
_BLOB = r"b?\"[^\"\s]{20,}+\"|b?'[^'\s]{20,}+'"
_DATA_LINE = rf"(?m)^[ \t]*+(?:(?:{_NUMBER}|{_BLOB})[ \t]*+[,+]?+[ \t]*+)(?:(?:{_NUMBER}|{_BLOB})[ \t]*+,?+[ \t]*+)*+[)\]}};]*+[ \t\r]*+$"
_LONG_BLOB = r"[\"'`][A-Za-z0-9+/=\\]{400,}+[\"'`]"
_LONG_LINE = r"(?m)^[^\n]{300,}+$"


def content_key(code: Column, lang: Column) -> Column:
    """The text without comments and white space, by which copies are known; empty if nothing is left."""
    python = F.regexp_replace(code, r"#[^\n]*|\s+", "")
    braces = F.regexp_replace(code, r"(?s:/\*.*?\*/)|//[^\n]*|\s+", "")
    return F.when(lang == "python", python).otherwise(braces)


def signals(files: DataFrame, *, id_col="file_id", path_col="file_path", project_col="project_id",
            language_col="language", code_col="code") -> DataFrame:
    """One row per delivered row: file_id, project, path, lang, the content's hash, and what the row itself tells."""
    base = files.select(
        F.col(id_col).cast("long").alias("file_id"),
        F.coalesce(F.col(project_col), F.lit("")).alias("project"),
        F.coalesce(F.col(path_col), F.lit("")).alias("path"),
        language_of(F.col(language_col), F.col(path_col)).alias("lang"),
        F.coalesce(F.col(code_col), F.lit("")).alias("code"),
    ).where("file_id is not null")
    code = F.col("code")
    keyed = base.withColumn("text", F.when(F.col("lang").isin(*CODE), content_key(code, F.col("lang"))))
    head = F.when(F.col("lang") == "python", F.regexp_extract("code", _PYTHON_HEAD, 0)).otherwise(F.regexp_extract("code", _HEAD, 0))
    long = F.array_join(F.regexp_extract_all("code", F.lit(_LONG_LINE), 0), "")
    # only scripts can be minified; strings hold few of these marks
    marks = F.length(long) - F.length(F.regexp_replace(long, "[;{}]", ""))
    total = F.length("code")
    data = total - F.length(F.regexp_replace(F.regexp_replace("code", _DATA_LINE, ""), _LONG_BLOB, ""))
    dirs = F.split(F.lower("path"), "/")
    in_foreign = F.arrays_overlap(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), F.array(*map(F.lit, FOREIGN_DIRS)))
    named = F.lower(F.regexp_extract(head, _BANNER, 1))
    foreign_name = (named != "") & ~F.contains(F.lower("project"), named)
    lines = F.array(
        F.when(in_foreign | foreign_name | head.rlike(_THIRD), F.lit("third-party")),
        F.when(head.rlike(_GENERATED), F.lit("generated")),
        F.when((F.col("lang") == "javascript") & (F.length(long) > 0.5 * total) & (marks > 0.02 * F.length(long)), F.lit("minified")),
        F.when((data > 800) & (data > 0.5 * total), F.lit("data")),
    )
    return keyed.select(
        "file_id",
        "project",
        "path",
        "lang",
        F.when(F.col("text") != "", F.md5("text")).alias("h"),
        F.when(F.col("text") != "", F.get(F.filter(lines, lambda x: x.isNotNull()), F.lit(0))).alias("told"),
        "code",
    )


def _with_validity(rows: DataFrame) -> DataFrame:
    """Adds ``valid`` where a row is told to be foreign; other code never leaves the JVM."""
    schema = "file_id long, project string, path string, lang string, h string, told string, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, told, codes = (batch.column(i).to_pylist() for i in (3, 5, 6))
            ok = [None if t is None else checks.valid(c, x) for x, t, c in zip(langs, told, codes)]
            cols = [batch.column(i) for i in range(6)]
            names = ["file_id", "project", "path", "lang", "h", "told", "valid"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ok, pa.bool_())], names=names)

    chosen = rows.select(
        "file_id", "project", "path", "lang", "h", "told", F.when(F.col("told").isNotNull(), F.col("code")).alias("suspect")
    )
    return chosen.mapInArrow(run, schema)


def _directories(path: Column) -> Column:
    """The directories above a path, the project's root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def _with_directories(files: DataFrame) -> DataFrame:
    return files.where("h is not null").select("project", "path", "h").distinct()


def merkle(files: DataFrame) -> DataFrame:
    """(project, path, node_hash, n_files) of every file and directory; ``files`` has project, path and h."""
    leaves = _with_directories(files)
    words = [F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"w{k}") for k in range(4)]
    sums = [F.sum(f"w{k}").alias(f"w{k}") for k in range(4)]
    above = leaves.select("project", F.explode(_directories(F.col("path"))).alias("path"), *words)
    folders = above.groupBy("project", "path").agg(F.count("*").alias("n_files"), *sums)
    node = F.concat(F.lit("d"), F.md5(F.concat_ws(" ", "n_files", *(f"w{k}" for k in range(4)))))
    return leaves.select("project", "path", F.col("h").alias("node_hash"), F.lit(1).cast("long").alias("n_files")).unionByName(
        folders.select("project", "path", node.alias("node_hash"), "n_files")
    )


def shared_subtrees(tree: DataFrame, min_projects: int = 2) -> DataFrame:
    """(node_hash, n_projects) of the files and directories that occur in several projects."""
    per_project = tree.groupBy("node_hash", "project").agg(F.count("*").alias("n"))
    return per_project.groupBy("node_hash").agg(F.count("*").alias("n_projects")).where(F.col("n_projects") >= min_projects)


def copied_files(files: DataFrame, *, min_projects: int = 2, min_files: int = 2) -> DataFrame:
    """(project, path, subtree, n_projects) of the files that several projects hold.

    ``subtree`` is the topmost directory of at least ``min_files`` files around the
    file that they share, or the file itself where they share no more than that.
    """
    tree = cut_lineage(merkle(files))
    shared = tree.join(shared_subtrees(tree, min_projects), "node_hash")
    is_folder = F.length("node_hash") > 32
    folders = shared.where(is_folder & (F.col("n_files") >= min_files)).select("project", F.col("path").alias("subtree"), "n_projects")
    above = _with_directories(files).select("project", "path", F.explode(_directories(F.col("path"))).alias("subtree"))
    inside = above.join(folders, ["project", "subtree"])
    single = shared.where(~is_folder).select("project", "path", F.col("path").alias("subtree"), "n_projects")
    # the topmost one is the shortest
    top = F.min(F.struct(F.length("subtree").alias("k"), "subtree", "n_projects")).alias("top")
    every = inside.select("project", "path", "subtree", "n_projects").unionByName(single)
    return every.groupBy("project", "path").agg(top).select("project", "path", "top.subtree", "top.n_projects")


def classify(files: DataFrame, **columns) -> DataFrame:
    """(file_id, origin) of every file."""
    rows = signals(files, **columns)
    seen = cut_lineage(_with_validity(rows))
    copies = copied_files(seen).select("project", "path", F.lit(True).alias("copied"))
    marked = cut_lineage(seen.join(copies, ["project", "path"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)) & F.col("h").isNotNull()))
    # a copy that nothing else tells: one of each text is parsed
    unread = marked.where("copied and told is null").groupBy("h").agg(F.min("file_id").alias("file_id"))
    texts = files.select(
        F.col(columns.get("id_col", "file_id")).cast("long").alias("file_id"),
        language_of(F.col(columns.get("language_col", "language")), F.col(columns.get("path_col", "file_path"))).alias("lang"),
        F.col(columns.get("code_col", "code")).alias("code"),
    )
    parsed = _parse(unread.join(texts, "file_id").select("h", "lang", "code")).groupBy("h").agg(F.max("ok").alias("ok"))
    told = F.when(F.col("copied") & F.col("told").isNull(), F.lit("third-party")).otherwise(F.col("told"))
    valid = F.coalesce("valid", "ok", F.lit(True))
    origin = (
        F.when(~F.coalesce(F.col("lang").isin(*CODE), F.lit(False)), F.lit("config"))
        .when(F.col("h").isNull(), F.lit("empty"))
        .when(told.isNull(), F.lit("hand-written"))
        .when(~valid, F.lit("invalid"))
        .otherwise(told)
    )
    order = F.array(*map(F.lit, ["third-party", "generated", "minified", "data", "hand-written", "config", "empty", "invalid"]))
    ranked = marked.join(parsed, "h", "left").select("file_id", origin.alias("origin"))
    best = ranked.groupBy("file_id").agg(F.min(F.struct(F.array_position(order, F.col("origin")).alias("k"), "origin")).alias("b"))
    return best.select("file_id", "b.origin")


def _parse(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [checks.valid(c, x) for x, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok, pa.bool_())], names=["h", "ok"])

    return rows.mapInArrow(run, "h string, ok boolean")
