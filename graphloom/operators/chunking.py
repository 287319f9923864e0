"""Texts as chunks: words, sentences and paragraphs packed to a size, with or without overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKS = ".;!?…。！？"
_ABBREVIATION = re.compile(r"\b(?:e\.g|i\.e|etc|vs|Mr|Mrs|Dr|No|Fig|cf|approx)\.$")


def split_words(text: str) -> list[tuple[str, str]]:
    """(word with what follows it, kind): word, sentence_end, paragraph_end."""
    out = []
    for m in re.finditer(r"\S+\s*", text):
        token = m.group()
        word = token.rstrip()
        kind = "word"
        if word[-1:] in _MARKS and not _ABBREVIATION.search(word):
            kind = "paragraph_end" if "\n" in token else "sentence_end"
        out.append((token, kind))
    return out


def split_sentences(text: str, max_words: int | None = None) -> list[tuple[str, int, str]]:
    """(sentence, number of words, kind); one that reaches ``max_words`` is cut there."""
    out: list[tuple[str, int, str]] = []
    held, n = "", 0
    for token, kind in split_words(text):
        held += token
        n += 1
        if kind != "word" or n == max_words:
            out.append((held, n, kind if kind != "word" else "sentence_cut"))
            held, n = "", 0
    if held:
        out.append((held, n, "sentence_cut"))
    return out


def pack_chunks(text: str, max_words: int, overlap: float = 0.0) -> list[tuple[str, int, str]]:
    """(chunk, number of words, cut type): whole sentences packed greedily; the last sentences of a chunk, up to
    ``overlap`` of its size, open the next one."""
    chunks: list[tuple[str, int, str]] = []
    held: list[tuple[str, int, str]] = []
    size = fresh = 0
    for s in split_sentences(text, max_words):
        if held and size + s[1] > max_words:
            chunks.append(("".join(x[0] for x in held).strip(), size, held[-1][2]))
            tail: list[tuple[str, int, str]] = []
            room = int(overlap * max_words)
            for x in reversed(held):
                if x[1] > room or x[1] + s[1] > max_words:
                    break
                tail.insert(0, x)
                room -= x[1]
            held, size, fresh = tail, sum(x[1] for x in tail), 0
            while held and size + s[1] > max_words:
                size -= held.pop(0)[1]
        held.append(s)
        size += s[1]
        fresh += 1
    if fresh:
        chunks.append(("".join(x[0] for x in held).strip(), size, held[-1][2]))
    return chunks


def split_rows(text: str, max_words: int) -> list[tuple[str, int, str]]:
    """(fields, number of words, kind): blocks between blank lines, cut between fields where they grow too large."""
    out = []
    for block in re.split(r"\n\s*\n", text):
        held, n = [], 0
        for fld in filter(None, (f.strip() for f in block.split(", "))):
            k = len(fld.split())
            if held and n + k > max_words:
                out.append((", ".join(held), n, "row_cut"))
                held, n = [], 0
            held.append(fld)
            n += k
        if held:
            out.append((", ".join(held), n, "row_end"))
    return out


def chunk(documents: DataFrame, *, id_col: str, text_col: str, max_words: int = 80, overlap: float = 0.0, rows: bool = False) -> DataFrame:
    """(document_id, chunk_index, chunk_size, cut_type, text) of every text; null and blank ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = split_rows(text, max_words) if rows else pack_chunks(text, max_words, overlap)
                for k, (body, n, kind) in enumerate(made):
                    for col, v in zip(cols, (doc, k, n, kind, body)):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ["document_id", "chunk_index", "chunk_size", "cut_type", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    chosen = documents.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.trim(text_col) != "")
    return chosen.mapInArrow(run, "document_id long, chunk_index int, chunk_size int, cut_type string, text string")


_SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def recursive_split(text: str, max_words: int, overlap: int = 0, separators: tuple[str, ...] = _SEPARATORS) -> list[str]:
    """Pieces of at most ``max_words`` words, cut at the first separator that parts the text, then at finer ones.

    ``overlap`` words of a piece are repeated at the start of the next, where both fit.
    """

    def cut(part: str, seps: tuple[str, ...]) -> list[str]:
        if len(part.split()) <= max_words:
            return [part] if part.strip() else []
        sep, *finer = seps
        if not sep:
            words = part.split()
            return [" ".join(words[k : k + max_words]) for k in range(0, len(words), max_words)]
        out: list[str] = []
        held = ""
        for piece in part.split(sep):
            joined = f"{held}{sep}{piece}" if held else piece
            if len(joined.split()) <= max_words:
                held = joined
                continue
            if held.strip():
                out.append(held)
            held = ""
            small = cut(piece, tuple(finer))
            out += small[:-1]
            held = small[-1] if small else ""
        return [*out, held] if held.strip() else out

    pieces = [p.strip() for p in cut(text, separators)]
    if not overlap:
        return pieces
    out = pieces[:1]
    for before, piece in zip(pieces, pieces[1:]):
        room = min(overlap, max_words - len(piece.split()))
        tail = before.split()[-room:] if room > 0 else []
        out.append(" ".join([*tail, piece]) if tail else piece)
    return out


_HAN = re.compile(r"[㐀-鿿]")
_SPEAKER = re.compile(r"^\s*([^\s:：][^:：\n]{0,30})[:：]\s*(.+)$")
_HAN_END = re.compile(r"(?<=[。！？；])")


def smart_sentences(text: str, kind: str = "") -> list[str]:
    """Sentences by the sort of text: a dialogue's lines by speaker, Chinese at its marks, others at theirs, abbreviations aside."""
    if kind == "dialog":
        out: list[str] = []
        for line in filter(str.strip, text.split("\n")):
            if _SPEAKER.match(line) or not out:
                out.append(line.strip())
            else:
                out[-1] += " " + line.strip()
        return out
    solid = re.sub(r"\s", "", text)
    if solid and len(_HAN.findall(solid)) > 0.3 * len(solid):
        return [s.strip() for line in text.split("\n") for s in _HAN_END.split(line) if s.strip()]
    return [s.strip() for s, _, _ in split_sentences(text) if s.strip()]


def positions(text: str, sentences: list[str]) -> list[tuple[str, int, int]]:
    """Where each sentence lies in its text, white space aside; sentences are sought in order."""
    out, at = [], 0
    for s in sentences:
        pattern = re.compile(r"\s*".join(map(re.escape, s.split())))
        m = pattern.search(text, at)
        if m:
            out.append((s, m.start(), m.end()))
            at = m.end()
    return out


def code_chunks(path: str, text: str, max_words: int = 400) -> list[tuple[str, str, int, int]]:
    """(name, chunk, first line, last line) of the outermost functions and the methods of classes, with the names around them in front.

    A file in another language, or one that gives no such part, is packed as a text.
    """
    from graphloom.operators import codegraph, javagraph

    derive = {"py": codegraph.derive, "java": javagraph.derive}.get(path.rpartition(".")[2])
    nodes, edges = derive(path, text) if derive else ([], [])
    kinds = {n[0]: n for n in nodes}
    above = {dst: src for src, dst, kind, _ in edges if kind == "CONTAINS"}
    lines = text.split("\n")
    out = []
    for i, kind, name, a, b, _ in nodes:
        owner = kinds.get(above.get(i, ""))
        if kind in ("function_definition", "method_declaration") and owner and owner[1] in ("file", "class_definition"):
            around, up = [], owner
            while up and up[1] == "class_definition":
                around.insert(0, up[2])
                up = kinds.get(above.get(up[0], ""))
            full = ".".join([*around, name])
            out.append((full, f"{path} > {full}\n" + "\n".join(lines[a - 1 : b]), a, b))
    if out:
        return out
    return [("", body, 0, 0) for body, _, _ in pack_chunks(text, max_words)]


def code_chunk_rows(files: DataFrame, *, path_col: str = "file_path", code_col: str = "code") -> DataFrame:
    """(file_path, pos, name, first_line, last_line, chunk) of every file with a path and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (path, k, name, a, b, body)
                for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for k, (name, body, a, b) in enumerate(code_chunks(path, code))
            ]
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file_path", "pos", "name", "first_line", "last_line", "chunk"])

    chosen = files.select(F.col(path_col).alias("p"), F.col(code_col).alias("c")).where("p is not null and trim(c) <> ''").distinct()
    return chosen.mapInArrow(run, "file_path string, pos int, name string, first_line int, last_line int, chunk string")


def sentence_rows(documents: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(document_id, pos, start, end, sentence): the sentences of every text by its sort, a speaker in its first line making it a dialogue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = text.lstrip().split("\n", 2)
                spoken = len(first) > 1 and all(_SPEAKER.match(x) for x in first[:2])
                found = positions(text, smart_sentences(text, "dialog" if spoken else ""))
                rows += [(doc, k, a, b, s) for k, (s, a, b) in enumerate(found)]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["document_id", "pos", "start", "end", "sentence"])

    chosen = documents.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.trim(text_col) != "")
    return chosen.mapInArrow(run, "document_id long, pos int, start int, end int, sentence string")
