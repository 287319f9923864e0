"""Credentials in source code and settings: found and masked.

Lines with a hint of a credential are cut into lexical tokens; a linear-chain
conditional random field labels them by shape and context, and the spans of its
best labelling (Viterbi) are exactly the characters that are masked. The field is
trained when it is first used, on ``TRAINING_LINES`` lines that
``credential_training`` writes: a bound that doesn't depend on the data.

Each file is handled on its own, so nothing is shuffled but the distinct results.

Defined results for odd input
-----------------------------
* Null, empty and blank code holds nothing; a null path counts as plain text.
* Lines are parted by \\n and counted from 1; a carriage return stays as it is.
* A private key or a joined string counts once, where its value begins; all its
  parts are masked. Each masked character becomes ``*``; all others, line ends
  included, stay.
* Repeated rows of a file give one set of lines. Rows with null ids are dropped.
* Texts of any length are searched whole. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import credential_tokens as lex
from graphloom.llm.credential_training import labelled
from graphloom.llm.crf import LinearChainCRF

TRAINING_LINES = 12_000
_OPEN_SHAPES = frozenset("typed jwt hex base64 wordnum mixed plain uuid tagged".split())
_CLOSED_SHAPES = frozenset("empty reference placeholder".split())


def tagged_line(ext: str, line: str) -> tuple[list[lex.Token], list[list[str]]]:
    tokens = lex.line_tokens(line, 0, len(line), ext, {})
    return tokens, lex.features(tokens, ext)


@lru_cache(maxsize=1)
def model() -> LinearChainCRF:
    data = []
    for ext, line, spans in labelled(TRAINING_LINES, seed=11):
        tokens, features = tagged_line(ext, line)
        labels = [int(any(a <= t.spans[0][0] and t.spans[-1][1] <= b for a, b in spans)) for t in tokens]
        data.append((features, labels))
    for kind, label in (("private", 1), ("public", 0)):
        data += [(lex.features([lex.Token("", [(0, 0)], "pem", kind)], ""), [label])] * 100
    return LinearChainCRF().fit(data)


def _open(t: lex.Token) -> bool:
    """Whether a token can be a credential: by its shape, or by a name that says so."""
    if t.kind in ("op", "key"):
        return False
    form = lex.shape(t.text)
    return form in _OPEN_SHAPES or form not in _CLOSED_SHAPES and (t.kind == "pass" or lex.key_class(t.key) == "secret")


def find(text: str, ext: str, crf: LinearChainCRF, every_line: bool = False) -> list[list[lex.Span]]:
    """The spans of each credential, in order; the first span of each is where its value begins.

    ``every_line`` tags lines without a hint, too: slower, to measure what the hints lose.
    """
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    out: list[list[lex.Span]] = []
    closed: list[lex.Span] = []
    if "-----BEGIN " in text:
        for t in lex.pem_tokens(text):
            closed.append((t.spans[0][0], t.spans[-1][1]))
            if crf.viterbi(lex.features([t], ext)) == [1]:
                out.append(t.spans)
    done = -1
    joined = lex.joined_literals(text, ext)
    for k in range(len(starts)) if every_line else lex.candidate_lines(text, starts, joined):
        start = starts[k]
        end = starts[k + 1] - 1 if k + 1 < len(starts) else len(text)
        if start < done or any(a < end and start < b for a, b in closed):
            continue
        tokens = lex.line_tokens(text, start, end, ext, joined)
        if not any(map(_open, tokens)):
            continue
        labels = crf.viterbi(lex.features(tokens, ext))
        before = 0
        for t, label in zip(tokens, labels):
            if label and before and t.spans[0][0] - out[-1][-1][1] <= 1:
                out[-1] += t.spans  # neighbouring tokens are one credential
            elif label:
                out.append(list(t.spans))
            before = label
        done = max([done, *(t.spans[-1][1] for t in tokens if len(t.spans) > 1)])
    return sorted(out)


def mask(text: str, found: list[list[lex.Span]]) -> str:
    """The text with each character of the spans masked, PEM marks and line ends excepted."""
    out, at = [], 0
    for a, b in sorted(s for spans in found for s in spans):
        if text.startswith("-----BEGIN ", a) or a < at:
            continue
        out.append(text[at:a])
        out.append("".join(c if c in "\r\n" else "*" for c in text[a:b]))
        at = b
    return "".join(out) + text[at:]


def _files(files: DataFrame, id_col: str, path_col: str, code_col: str) -> DataFrame:
    ext = F.coalesce(F.lower(F.regexp_extract(path_col, r"\.([^./]*)$", 1)), F.lit(""))
    return files.select(F.col(id_col).cast("long").alias("file_id"), ext.alias("ext"), F.col(code_col).alias("code")).where(
        F.col("file_id").isNotNull() & F.col("code").isNotNull()
    )


def find_credentials(
    files: DataFrame, *, id_col: str = "file_id", path_col: str = "file_path", code_col: str = "code"
) -> DataFrame:
    """(file_id, line_no, start, end) of each credential; start and end count characters from 0."""
    crf = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for file_id, ext, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for spans in find(code, ext, crf):
                    row = (file_id, code.count("\n", 0, spans[0][0]) + 1, spans[0][0], spans[-1][1])
                    for c, v in zip(cols, row):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], names=["file_id", "line_no", "start", "end"]
            )

    return _files(files, id_col, path_col, code_col).mapInArrow(run, "file_id long, line_no int, start int, end int")


def redact(files: DataFrame, *, id_col: str = "file_id", path_col: str = "file_path", code_col: str = "code") -> DataFrame:
    """(file_id, n_credentials, code) with the credentials masked."""
    crf = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, texts = [], [], []
            for file_id, ext, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = find(code, ext, crf)
                ids.append(file_id)
                counts.append(len(found))
                texts.append(mask(code, found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(texts, pa.string())],
                names=["file_id", "n_credentials", "code"],
            )

    return _files(files, id_col, path_col, code_col).mapInArrow(run, "file_id long, n_credentials int, code string")
