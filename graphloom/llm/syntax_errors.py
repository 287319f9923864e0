"""Source files that don't parse, flagged per file.

Lexing is a reduction of chunk maps (``syntax.lexing``): each chunk of a file
becomes a map from the lexer states it may be entered in to the state at its end
and a summary of its brackets; maps compose associatively. With the entry states
known, chunks become skeletons; if the brackets of the file match, its statements
are parsed by local grammars, each different statement once.

A file of up to ``chunk_chars`` characters is folded where it is read, chunk by
chunk, without a shuffle. The maps of longer files are made in parallel and reduced
per file, and their skeletons are joined: tiny rows, as names, literals and comments
are gone. Both ways make the same skeleton, so a file's verdict doesn't depend on
its length. What the local grammar of Python rejects is confirmed by the exact
parser on the whole text, as is (with its own grammar) a file with templates nested
deeper over a cut than the maps tell apart. XML has no chunks: its tags are matched
in one pass, and what that rejects is confirmed by the exact parser.

Defined results for odd input
-----------------------------
* Null and blank code and code of comments only are valid.
* Languages count in any case and without outer blanks; where the language is
  null or blank, the extension of the path tells it. Files of other languages are
  valid. A null path has no extension.
* Repeated rows of one file give one verdict; if rows of one id differ, the file
  is invalid as soon as one of its rows is. A null id is dropped.
* Tables and objects of any length are checked whole. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.syntax import files as checks
from graphloom.llm.syntax.lexing import CODE, LANGUAGES, UNKNOWN, brackets, chunk_map, chunks, compose_maps
from graphloom.session import cut_lineage

#: File extensions and what they are written in.
EXTENSIONS = {
    "py": "python",
    "java": "java",
    "js": "javascript",
    "json": "json",
    "xml": "xml",
    "properties": "properties",
    "yml": "yaml",
    "yaml": "yaml",
    "env": "dotenv",
}
_ALIASES = {"py": "python", "python3": "python", "js": "javascript", "yml": "yaml", "env": "dotenv"}


def language_of(language: Column, path: Column) -> Column:
    """The normal name of a language, by the extension where it is missing."""
    given = F.lower(F.trim(language))
    names = F.create_map(*[F.lit(x) for pair in _ALIASES.items() for x in pair])
    given = F.coalesce(names[given], given)
    ends = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    by_path = ends[F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))]
    return F.when(given.isNull() | (given == ""), by_path).otherwise(given)


def _batches(rows: Iterator[pa.RecordBatch], judge) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        verdicts = [judge(code, lang) for lang, code in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verdicts, pa.bool_())], names=["file_id", "valid"])


def _small(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(lambda it: _batches(it, checks.valid), "file_id long, valid boolean")


def _cut(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for file_id, lang, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
            parts = chunks(checks.normal(code), size)
            yield pa.RecordBatch.from_pydict(
                {
                    "file_id": pa.array([file_id] * len(parts), pa.int64()),
                    "lang": pa.array([lang] * len(parts), pa.string()),
                    "seq": pa.array(range(len(parts)), pa.int32()),
                    "part": pa.array(parts, pa.string()),
                }
            )


def _map(part: str, lang: str) -> dict[str, tuple[str, str | None]]:
    if lang == "json":
        return {CODE: (CODE, brackets(checks.shape_of(part, lang, CODE)[0]))}
    return chunk_map(part, LANGUAGES[lang])


def _maps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows: list[tuple] = []
        for file_id, lang, seq, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for state, (end, left) in _map(part, lang).items():
                rows.append((file_id, seq, state, end, left))
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        names = ["file_id", "seq", "state", "exit", "brackets"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each chunk of one file, and whether its lexer ends in code and its brackets match."""
    maps = [
        {s: (e, None if pd.isna(b) else b) for s, e, b in zip(g["state"], g["exit"], g["brackets"])}
        for _, g in sorted(pdf.groupby("seq"), key=lambda x: x[0])
    ]
    entries, state = [], CODE
    for m in maps:
        entries.append(state)
        state = m[state][0] if state in m else UNKNOWN
    while len(maps) > 1:  # associative: neighbours are composed pairwise
        maps = [compose_maps(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    balanced = maps[0][CODE] == (CODE, "")
    return pd.DataFrame(
        {
            "file_id": pdf["file_id"].iloc[0],
            "seq": range(len(entries)),
            "entry": entries,
            "balanced": balanced,
            "known": state != UNKNOWN,
        }
    ).astype({"seq": "int32"})


def _skeletons(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        lang, part, entry = (batch.column(i).to_pylist() for i in (1, 3, 4))
        made = [checks.shape_of(p, x, e)[0] for x, p, e in zip(lang, part, entry)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(made, pa.string())],
            names=["file_id", "lang", "seq", "shape"],
        )


def _join_skeletons(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    ok = checks.statements_valid("".join(pdf["shape"]), pdf["lang"].iloc[0])
    return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "valid": [ok]})


def _large(rows: DataFrame, size: int) -> DataFrame:
    # rows of one id that differ are different texts; equal ones are cut once
    texts = rows.distinct().withColumn("text_id", F.xxhash64("file_id", "lang", F.md5("code")))
    cut = texts.select(F.col("text_id").alias("file_id"), "lang", "code")
    parts = cut.mapInArrow(lambda it: _cut(it, size), "file_id long, lang string, seq int, part string")
    maps = parts.mapInArrow(_maps, "file_id long, seq int, state string, exit string, brackets string")
    entries = cut_lineage(
        maps.groupBy("file_id").applyInPandas(_reduce, "file_id long, seq int, entry string, balanced boolean, known boolean")
    )
    fit = entries.where("balanced and known").select("file_id", "seq", "entry")
    shapes = parts.join(fit, ["file_id", "seq"]).select("file_id", "lang", "seq", "part", "entry").mapInArrow(
        _skeletons, "file_id long, lang string, seq int, shape string"
    )
    parsed = shapes.groupBy("file_id").applyInPandas(_join_skeletons, "file_id long, valid boolean")
    unfit = entries.where("seq = 0 and not (balanced and known)").select("file_id", F.lit(False).alias("valid"), "known")
    judged = cut_lineage(parsed.withColumn("known", F.lit(True)).unionByName(unfit)).withColumnRenamed("file_id", "text_id")
    # what isn't accepted goes back to its whole text: Python's exact parser, or the fold that knows every state
    again = ~F.col("valid") & ((F.col("lang") == "python") | ~F.col("known"))
    ids = judged.join(texts.select("text_id", "file_id", "lang"), "text_id")
    doubted = texts.join(judged.where("not valid").select("text_id", "known"), "text_id").where("lang = 'python' or not known")
    return ids.where(~again).select("file_id", "valid").unionByName(_small(doubted.select("file_id", "lang", "code")))


def verdicts(
    files: DataFrame,
    *,
    id_col: str = "file_id",
    path_col: str = "file_path",
    language_col: str = "language",
    code_col: str = "code",
    chunk_chars: int = 1_000_000,
) -> DataFrame:
    """(file_id, valid) of each row in one of the checked languages whose code isn't null."""
    rows = files.select(
        F.col(id_col).cast("long").alias("file_id"),
        language_of(F.col(language_col), F.col(path_col)).alias("lang"),
        F.col(code_col).alias("code"),
    ).where(F.col("file_id").isNotNull() & F.col("lang").isin(*checks.CHECKED) & F.col("code").isNotNull())
    remark = (F.col("lang") == "json") & F.ltrim("code").rlike(r"^[\s\x{FEFF}]*+[/#]")  # only a remark or invalid
    long = (F.char_length("code") > chunk_chars) & F.col("lang").isin(*checks.CUT) & ~remark
    return _small(rows.where(~long)).unionByName(_large(rows.where(long), chunk_chars))


def invalid_files(files: DataFrame, **options) -> DataFrame:
    """(file_id) of every file that doesn't parse, once."""
    return verdicts(files, **options).where("not valid").select("file_id").distinct()


def error_rates(
    files: DataFrame,
    *,
    project_col: str = "project_id",
    id_col: str = "file_id",
    path_col: str = "file_path",
    language_col: str = "language",
    **options,
) -> DataFrame:
    """(project_id, language, n_files, n_invalid, rate) over the checked languages; each file counts once."""
    found = verdicts(files, id_col=id_col, path_col=path_col, language_col=language_col, **options)
    by_file = found.groupBy("file_id").agg(F.min(F.col("valid").cast("int")).alias("valid"))
    place = (
        files.select(
            F.col(id_col).cast("long").alias("file_id"),
            F.col(project_col).alias("project_id"),
            language_of(F.col(language_col), F.col(path_col)).alias("language"),
        )
        .groupBy("file_id")
        .agg(F.min(F.struct("project_id", "language")).alias("p"))
    )
    return (
        by_file.join(place, "file_id")
        .groupBy("p.project_id", "p.language")
        .agg(F.count("*").alias("n_files"), F.sum(1 - F.col("valid")).alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
