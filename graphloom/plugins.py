"""What callers can plug in: languages, embedders, scorers, retrievers, and the expansion of functions on demand."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import codegraph, javagraph
from graphloom.session import cut_lineage

Rows = list[tuple]


class Language(Protocol):
    """A language: the nodes and edges of a file's text."""

    extensions: tuple[str, ...]

    def graph(self, path: str, text: str) -> tuple[Rows, Rows]:
        """(nodes, edges) as ``codegraph.derive`` gives them."""
        ...


@dataclass
class Python:
    extensions: tuple[str, ...] = (".py",)

    def graph(self, path: str, text: str) -> tuple[Rows, Rows]:
        return codegraph.derive(path, text)


@dataclass
class Java:
    extensions: tuple[str, ...] = (".java",)

    def graph(self, path: str, text: str) -> tuple[Rows, Rows]:
        return javagraph.derive(path, text)


@dataclass
class Languages:
    """Languages by the extension of a path; a later registration replaces an earlier one."""

    by_extension: dict[str, Language] = field(default_factory=dict)

    def register(self, language: Language) -> Languages:
        for e in language.extensions:
            self.by_extension[e] = language
        return self

    def graph(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of files (file_path, code) in a known language; files that can't be read give nothing."""
        known = dict(self.by_extension)
        ends = F.regexp_extract("file_path", r"(\.[^./]*)$", 1)
        rows = files.where(F.col("code").isNotNull() & ends.isin(*known)).select("file_path", "code")

        def run(which: int, names: list[str], kinds: list[pa.DataType]):
            def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out: Rows = []
                    for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        try:
                            made = known[path[path.rindex(".") :]].graph(path, code)[which]
                        except (SyntaxError, ValueError, RecursionError):
                            continue
                        out += [(path, *r) for r in made]
                    cols = list(zip(*out)) if out else [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

            return go

        s, i = pa.string(), pa.int32()
        nodes = rows.mapInArrow(run(0, codegraph.NODE_NAMES, [s, s, s, s, i, i, i]), codegraph.NODE_SCHEMA)
        edges = rows.mapInArrow(run(1, codegraph.EDGE_NAMES, [s] * 5), codegraph.EDGE_SCHEMA)
        return nodes, edges


DEFAULT = Languages().register(Python()).register(Java())


def expand(functions: DataFrame, languages: Languages = DEFAULT, only: DataFrame | None = None) -> DataFrame:
    """(file_path, src, dst, edge_type, detail): the inner edges of functions (id, file_path, source_code), all or those in ``only`` (id)."""
    rows = functions if only is None else functions.join(only.select("id"), "id", "left_semi")
    # a function is parsed as a file of its own, named by its id and extension
    path = F.concat("id", F.regexp_extract("file_path", r"(\.[^./]*)$", 1))
    return languages.graph(rows.select(path.alias("file_path"), F.col("source_code").alias("code")))[1]


@dataclass
class ExpansionCache:
    """Expanded functions, kept in written tables: each is parsed once."""

    languages: Languages = field(default_factory=lambda: DEFAULT)
    done: DataFrame | None = None
    edges: DataFrame | None = None

    def get(self, functions: DataFrame) -> DataFrame:
        """The inner edges of ``functions``; those that aren't in the cache are expanded and added."""
        asked = functions.select("id", "file_path", "source_code")
        missing = asked if self.done is None else asked.join(self.done, "id", "left_anti")
        fresh = cut_lineage(expand(missing, self.languages))
        ids = cut_lineage(missing.select("id").distinct())
        self.edges = fresh if self.edges is None else self.edges.unionByName(fresh)
        self.done = ids if self.done is None else self.done.unionByName(ids)
        owner = F.regexp_replace("file_path", r"\.[^./]*$", "")
        return self.edges.join(asked.select(F.col("id").alias("owner")), owner == F.col("owner"), "left_semi")


class Embedder(Protocol):
    size: int
    most_words: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class HashingEmbedder:
    """Deterministic vectors by hashed words: for tests, and where no model is at hand."""

    size: int = 64
    most_words: int = 512

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for k, text in enumerate(texts):
            words = text.lower().split()
            if len(words) > self.most_words:
                raise OverflowError(f"more than {self.most_words} words")
            for w in words:
                h = zlib.crc32(w.encode())
                out[k, h % self.size] += 1 if h >> 16 & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def embed_all(embedder: Embedder, texts: list[str]) -> np.ndarray:
    """Vectors of texts of any length: a batch that is too large is halved; of one text that is, the first and the last two thirds are averaged."""
    try:
        return embedder.embed(texts)
    except OverflowError:
        if len(texts) > 1:
            half = len(texts) // 2
            return np.concatenate([embed_all(embedder, texts[:half]), embed_all(embedder, texts[half:])])
        words = texts[0].split()
        cut = max(1, 2 * len(words) // 3)
        if cut >= len(words):
            raise
        parts = [" ".join(words[:cut]), " ".join(words[-cut:])]
        return np.mean([embed_all(embedder, [p])[0] for p in parts], axis=0, keepdims=True)


def embed(rows: DataFrame, embedder: Embedder, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, vec) of every row whose text isn't blank, in Arrow batches."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = embed_all(embedder, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])

    return rows.where(F.trim(text_col) != "").select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, vec array<double>")


def score_with(pairs: DataFrame, scorer: Callable[[str, str], float], *, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """The pairs with the score of a callable; 0 where it fails."""

    def safe(q: str | None, t: str | None) -> float:
        try:
            return float(scorer(q, t))
        except Exception:
            return 0.0

    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = (batch.column(columns.index(c)).to_pylist() for c in (query_col, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(safe, q, t)), pa.float64())], names=[*columns, "score"])

    schema = ", ".join(f"`{c}` {k}" for c, k in pairs.dtypes)
    return pairs.mapInArrow(run, f"{schema}, score double")


def rerank(hits: DataFrame, scorer: Callable[[str, str], float] | None, k: int) -> DataFrame:
    """The first ``k`` hits (query_id, query, text, rank) by a scorer, in their own order without one or on ties."""
    from graphloom.operators.retrieval import top_k

    scored = hits.withColumn("score", F.lit(0.0)) if scorer is None else score_with(hits, scorer)
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("rank")], k, "place")


Retriever = Callable[..., DataFrame]


@dataclass
class Retrievers:
    """Recall modes by name; an unknown one is an error."""

    by_mode: dict[str, Retriever] = field(default_factory=dict)

    def register(self, mode: str, retriever: Retriever) -> Retrievers:
        self.by_mode[mode] = retriever
        return self

    def recall(self, mode: str, query: str, **options) -> DataFrame:
        if mode not in self.by_mode:
            raise ValueError(f"no recall mode is called {mode}")
        return self.by_mode[mode](query, **options)
