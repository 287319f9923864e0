"""Functions paired with their documentation, by windows over lexed tokens.

A text is lexed into tokens (comments, long strings, annotations, blank lines and
lines of code), one row each. Running sums over the rows of a text give the depth
of its brackets, the number of the function that a row belongs to and whether its
signature has ended. The comments directly above a signature form an island that
only annotations interrupt: each looks over the rows of its island to the row
behind it (an offset window that skips nulls), and if a function starts there,
the comment is attached to it. A docstring is a row whose row before, by ``lag``,
ended a signature. All windows have one order, so a text is sorted once, and the
record's own columns travel with its first token, so nothing is joined back.

A description is telling if four words or more, or some Chinese, are left of it
without tags, pragmas, separators, disabled code, to-dos, placeholders and mere
references, and if at least two of these aren't words of the function's own name.

Defined results for odd input
-----------------------------
* Rows with a null key or null source are dropped; of repeated rows of one key the
  last loaded counts. A null name leaves the words of the name unknown; a null
  signature is taken from the source.
* Texts without a function have no documentation of their own; a telling docstring
  column still gives a row for them.
* A comment that a blank line parts from the signature isn't attached.
* A comment, string or line of any length is one token; no pattern needs a stack or
  time beyond its text's length, so texts of any length are lexed whole. A comment
  or long string that isn't closed reaches to the end of the text.
* Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# every repeat of more than one kind of character is possessive: Java's others recurse once a round
_STRING = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_BLANK = r"\n[ \t\r]*+(?=\n)"
_LONG = "[rRuUbBfF]{0,2}(?:\"\"\"|''')"
_PY_TOKEN = (
    "[rRuUbBfF]{0,2}(?:\"\"\"(?s:.*?)(?:\"\"\"|\\z)|'''(?s:.*?)(?:'''|\\z))"
    rf"|{_BLANK}|(?:(?!{_LONG})(?:#[^\n]*+|{_STRING}|[^\n]))++"
)
_BRACE_TOKEN = (
    rf"/\*(?s:.*?)(?:\*/|\z)|\"\"\"(?s:.*?)(?:\"\"\"|\z)|{_BLANK}"
    rf"|(?:(?!/\*|\"\"\")(?://[^\n]*+|{_STRING}|[^\n]))++"
)
_PY_DEF = r"^\s*+(?:async\s++)?+def\s++\w++\s*+\("
_BRACE_DEF = (
    r"^\s*+(?!(?:if|for|while|switch|catch|return|new|throw|else|do|try|synchronized|function\s*+\(|await|yield)\b)"
    r"(?:[\w$<>\[\],.?@&]++\s++(?!\())*+(?:function\s*+\*?+\s*+)?+[\w$#]++\s*+\((?:[^;]*+$|(?=[^;{)]*+\))[^;{]*+\{)"
)
_PRAGMA = (
    r"(?im)^[ \t]*+(?:noqa\b|type:\s*ignore|pylint:|fmt:|yapf:|isort:|ruff:|mypy:|nosonar|@?ts-[a-z]+|eslint|prettier|jshint|istanbul"
    r"|region\b|endregion\b|#?pragma\b|coverage:|-\*-|!/|nolint|checkstyle|<editor-fold|suppress|sonar|flake8|nosec|c8 ignore|@formatter)[^\n]*+$"
)
_TAG = (
    r"(?im)^[ \t]*+(?:@\w+|:(?:param|type|return|returns|rtype|raises)\b|\\(?:param|return)\b"
    r"|(?:args|arguments|parameters|returns|raises|yields):)[^\n]*+$"
)
_DISABLED = (
    r"(?m)^[ \t]*+(?:(?:var|let|const|final|int|long|double|float|boolean|String|self|this)\b[\w.<>\[\]$\"' ]*+|[\w.\[\]$\"']++)"
    r"[ \t]*+[-+*/|&]?+=(?!=)[ \t]*+[^\s][^\n]*+$"
    r"|^[ \t]*+(?:await\s+|return\s+)?+[\w$]++(?:\.[\w$]++)*+\([^\n]*\)[ \t]*+;?+[ \t]*+$|^[^\n]*[;{}][ \t]*+$"
    r"|^[ \t]*+(?:if|for|while|elif|else|try|except|with|def|class|import|from|return)\b[^\n]*[:({][ \t]*+$"
    r"|^[ \t]*+import [\w.]++;?+[ \t]*+$|^[ \t]*+from [\w.]++ import [^\n]*+$"
)
_EMPTY = (
    r"(?im)^[^\w\n]*+(?:todo|fixme|xxx|tbd|hack|wip)\b[^\n]*+$|^[^\w\n]*+auto-?generated\b[^\n]*\bstub\b[^\n]*+$"
    r"|^[^\w\n]*+(?:document(?: me| this)?|(?:add|missing|no) (?:a )?"
    r"(?:docs?|documentation|description|docstring)|description|placeholder|undocumented|not documented|n/?a|none|docstring|comment)[^\w\n]*+$"
)
_ELSEWHERE = (
    r"(?im)\{?+@inheritdoc\}?+|^[^\w\n]*+(?:see|refer to|cf|same as|as|like|compare)\b(?:[ \t]++#?+[\w.#()]++){0,6}+[^\w\n]*+$"
    r"|^[^\w\n]*+the (?:[^\s]++ ){1,4}(?:method|function|procedure)[^\w\n]*+$|^[^\w\n]*+(?:inherited|overridden)(?: from [^\s]++)?+[^\w\n]*+$"
)
#: Words that add nothing to a name.
_FILLER = "the a an this that it its method function procedure routine helper implementation of for to and or is does do which be called named class".split()


def _lex(code: Column, lang: Column) -> Column:
    text = F.regexp_replace(code, "\r\n?+", "\n")
    return F.when(lang == "python", F.regexp_extract_all(text, F.lit(_PY_TOKEN), 0)).otherwise(
        F.regexp_extract_all(text, F.lit(_BRACE_TOKEN), 0)
    )


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def token_rows(texts: DataFrame, meta: Column | None = None) -> DataFrame:
    """One row per token of each text; ``texts`` has key, lang and code and is partitioned by key.

    ``meta`` goes with the first row of a text; a text without tokens has one row without a token.
    """
    meta = F.lit(None).cast("string") if meta is None else meta
    rows = texts.select("key", "lang", meta.alias("meta"), F.posexplode_outer(_lex(F.col("code"), F.col("lang"))).alias("pos", "tok"))
    t = F.col("tok")
    python = F.col("lang") == "python"
    kind = (
        F.when(t.isNull() | t.rlike(r"^\s*+$"), "blank")
        .when(
            (~python & (t.startswith("/*") | t.rlike(r"^\s*+(?://|\*)"))) | (python & t.rlike(r"^\s*+#")),
            "comment",
        )
        .when(t.rlike(f"^{_LONG}"), "string")
        .when(t.rlike(r"^\s*+@[\w.]++(?:\([^()]*+\))?+\s*+$"), "annotation")
        .otherwise("code")
    )
    rows = rows.select(
        "key",
        F.coalesce("pos", F.lit(0)).alias("pos"),
        "tok",
        "lang",
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("meta")).alias("meta"),
        kind.alias("kind"),
    )
    code = F.regexp_replace(F.regexp_replace(t, _STRING, "s"), r"//[^\n]*+$|(?<=\s)#[^\n]*+$", "")
    rows = rows.withColumn("plain", F.when(F.col("kind") == "code", code))
    plain = F.col("plain")
    return rows.select(
        "key",
        "pos",
        "tok",
        "lang",
        "meta",
        "kind",
        F.coalesce(_count(plain, "({[") - _count(plain, ")}]"), F.lit(0)).alias("delta"),
        F.coalesce(F.when(python, plain.rlike(_PY_DEF)).otherwise(plain.rlike(_BRACE_DEF)), F.lit(False)).alias("heads"),
        F.coalesce(F.when(python, plain.rlike(r":\s*+(?:$|\S)")).otherwise(plain.rlike(r"[{;]")), F.lit(False)).alias("closes"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """(key, fn, pos, meta, doc, head, lead): each token that is a docstring, a part of a signature or a comment above one."""
    whole = Window.partitionBy("key").orderBy("pos")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    python = F.col("lang") == "python"
    rows = rows.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    rows = rows.withColumn("starts", F.col("heads") & (python | (F.col("depth") <= 1)))
    rows = rows.withColumn("fn", F.sum(F.col("starts").cast("int")).over(upto)).withColumn(
        "base", F.last(F.when(F.col("starts"), F.col("depth")), ignorenulls=True).over(upto)
    )
    ends = (F.col("fn") > 0) & F.col("closes") & (~python | (F.col("depth") + F.col("delta") <= F.col("base")))
    rows = rows.withColumn("ends", ends)
    # an island of comments and annotations ends at the next other row; if a function starts there, it is attached
    rows = (
        rows.withColumn(
            "other", F.when(~F.col("kind").isin("comment", "annotation"), F.when(F.col("starts"), F.col("fn")).otherwise(0))
        )
        .withColumn("ended", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
        .withColumn("above", F.expr("lead(other, 1) ignore nulls over (partition by key order by pos)"))
    )
    rows = rows.withColumn("in_head", F.col("ended") == F.last(F.when(F.col("starts"), F.col("ended")), ignorenulls=True).over(upto))
    rows = rows.withColumn(
        "signed", F.when(~F.col("kind").isin("blank", "comment"), (F.col("ends") & F.col("in_head")).cast("int"))
    ).withColumn("first", F.expr("lag(signed, 1) ignore nulls over (partition by key order by pos)"))
    quoted = F.trim("tok").rlike("^[rRuU]?+(?:\"(?:[^\"\\\\]|\\\\.)*+\"|'(?:[^'\\\\]|\\\\.)*+')$")
    comment = F.col("kind") == "comment"
    return rows.select(
        "key",
        F.when(comment & (F.col("above") > 0), F.col("above")).otherwise(F.col("fn")).alias("fn"),
        "pos",
        "meta",
        F.when(
            python & (F.col("first") == 1) & ((F.col("kind") == "string") | ((F.col("kind") == "code") & quoted)), F.col("tok")
        ).alias("doc"),
        F.when((F.col("fn") > 0) & F.col("in_head") & (F.col("kind") == "code"), F.trim("tok")).alias("head"),
        F.when(comment & (F.col("above") > 0), F.col("tok")).alias("lead"),
    )


def _joined(value: str, sep: str, which: Column | None = None) -> Column:
    known = F.col(value).isNotNull() if which is None else F.col(value).isNotNull() & which
    listed = F.collect_list(F.when(known, F.struct("pos", F.col(value).alias("tok"))))
    return F.array_join(F.transform(F.array_sort(listed), lambda x: x.tok), sep)


def _bare(signature: str) -> Column:
    return F.regexp_replace(signature, r"(?<!\s)\s*+[:{]\s*+\}?+\s*+$", "")


def documented_functions(texts: DataFrame) -> DataFrame:
    """(key, fn, signature, lead, docstring) of each function in each text, fn counting from 1.

    ``texts`` has key, lang (python, or a language with braces) and code.
    """
    found = _placed(token_rows(texts)).where("fn > 0").groupBy("key", "fn").agg(
        F.max("doc").alias("docstring"), _joined("head", " ").alias("signature"), F.nullif(_joined("lead", "\n"), F.lit("")).alias("lead")
    )
    return found.select("key", "fn", _bare("signature").alias("signature"), "lead", "docstring")


def clean(doc: Column) -> Column:
    """The text of a comment or docstring without its marks."""
    text = F.regexp_replace(doc, "^\\s*+[rRuUbBfF]{0,2}(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')\\s*+$", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*+(?:/\*\*?|\*/|\*(?!/)|//+|#+)?+[ \t]*+|(?<![ \t*])[ \t]*+\*++/[ \t]*+$", "")
    return F.trim(F.regexp_replace(text, r"(?<![ \t])[ \t]++$", ""))


def description(doc: Column) -> Column:
    """What a documentation says, without the lines that say nothing."""
    text = clean(doc)
    for pattern in (_PRAGMA, _TAG, _EMPTY, _ELSEWHERE, _DISABLED, r"(?m)^[^\p{L}\n]*+$"):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(F.regexp_replace(text, r"\n\s*", "\n"))


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|_", " ")
    return F.transform(F.regexp_extract_all(F.lower(spaced), F.lit(r"\p{L}[\p{L}\p{N}]*"), 0), lambda w: F.regexp_replace(w, "(?<=..)s$", ""))


def says_more(text: Column, name: Column) -> Column:
    """Whether a description says more than the function's name."""
    known = F.concat(_words(F.coalesce(name, F.lit(""))), F.array(*map(F.lit, _FILLER)))
    words = _words(text)
    han = F.length(text) - F.length(F.regexp_replace(text, r"\p{IsHan}", ""))
    enough = (F.size(words) >= 4) & (F.size(F.array_except(words, known)) >= 2)
    return F.coalesce(enough | (han >= 4), F.lit(False))


def telling(doc: Column, name: Column) -> Column:
    """Whether a documentation says more than the function's name."""
    return says_more(description(doc), name)


def function_pairs(
    records: DataFrame,
    *,
    id_col: str = "id",
    name_col: str = "node_name",
    type_col: str = "node_type",
    source_col: str = "source_code",
    doc_col: str = "docstring",
    signature_col: str = "signature",
    order_col: str = "loaded_at",
    with_source: bool = True,
) -> DataFrame:
    """(node_id, signature, description[, source_code]) of the records with a telling documentation."""
    value = F.struct(
        F.coalesce(F.col(order_col).cast("string"), F.lit("")).alias("o"),
        F.col(name_col).alias("name"),
        F.col(type_col).alias("type"),
        F.col(source_col).alias("code"),
        F.col(doc_col).alias("doc"),
        F.col(signature_col).alias("sig"),
    )
    last = (
        records.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("key"))
        .agg(F.max(value).alias("r"))
        .select("key", "r.name", "r.type", "r.code", "r.doc", "r.sig")
        .where("code is not null")
    )
    lang = F.when((F.col("type") == "function_definition"), "python").otherwise("braces")
    own = F.struct("name", "doc", "sig", *(["code"] if with_source else []))
    first = _placed(token_rows(last.withColumn("lang", lang), own))
    one = F.col("fn") == 1
    found = (
        first.where("fn = 1 or meta is not null")
        .groupBy("key")
        .agg(
            F.max("meta").alias("m"),
            F.max(F.when(one, F.col("doc"))).alias("docstring"),
            _joined("head", " ", one).alias("read"),
            _joined("lead", "\n", one).alias("lead"),
        )
        .select("key", "m", "read", *(description(F.col(c)).alias(f"d{k}") for k, c in enumerate(("m.doc", "docstring", "lead"))))
    )
    name = F.col("m.name")
    told = F.coalesce(*(F.when(says_more(F.col(d), name), F.col(d)) for d in ("d0", "d1", "d2")))
    out = found.withColumn("description", told).where("description is not null")
    signature = F.coalesce(F.col("m.sig"), F.nullif(_bare("read"), F.lit("")))
    cols = [F.col("key").alias("node_id"), signature.alias("signature"), F.col("description")]
    return out.select(*cols, *([F.col("m.code").alias("source_code")] if with_source else []))
