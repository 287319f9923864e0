"""Derivations over the code graph: flow between functions, fields and collections, context cards, search by steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import traversal

#: The part of a path that tells a layer, in this order.
LAYERS = [("controller", "web"), ("api", "web"), ("service", "service"), ("repository", "data"), ("dao", "data"), ("model", "data"), ("util", "util"), ("test", "test")]
#: Methods that put a value into a collection, and those that take one out.
PUTS = "add addAll append put push insert offer set extend".split()
TAKES = "get remove pop poll peek first last next".split()
#: Rules (method, hint of the receiver or '', kind): where data come in, where they may do harm, what makes them harmless.
SECURITY_RULES = [
    ("getParameter", "request", "source"), ("getHeader", "request", "source"), ("readLine", "reader", "source"), ("input", "", "source"), ("getenv", "system", "source"),
    ("executeQuery", "statement", "sink"), ("executeUpdate", "statement", "sink"), ("execute", "cursor", "sink"), ("execute", "", "sink"), ("exec", "runtime", "sink"), ("eval", "", "sink"),
    ("system", "os", "sink"), ("write", "response", "sink"), ("print", "writer", "sink"), ("open", "", "sink"), ("load", "", "sink"),
    ("escapeHtml", "", "sanitizer"), ("encode", "encoder", "sanitizer"), ("setString", "statement", "sanitizer"), ("quote", "", "sanitizer"), ("sanitize", "", "sanitizer"),
]


def parameters(signature: Column) -> Column:
    """The parameter names of a signature in order, without a leading self or cls."""
    inner = F.regexp_replace(F.regexp_extract(signature, r"\(([^()]*)\)", 1), r"<[^<>]*>", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda p: p != "")
    # name: type = default, or type name
    names = F.transform(parts, lambda p: F.regexp_extract(F.regexp_replace(p, r"\s*[:=].*$", ""), r"([\w$]+)$", 1))
    return F.filter(names, lambda p: ~p.isin("", "self", "cls"))


def arguments(call: Column) -> Column:
    """The arguments of a flat call in order."""
    inner = F.regexp_extract(call, r"\(([^()]*)\)", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda a: a != "")


def argument_flow(calls: DataFrame) -> DataFrame:
    """(caller, callee, pos, argument, parameter): the values that calls hand over, by position.

    ``calls`` has caller, callee, call (its code) and signature (of the callee).
    """
    zipped = F.arrays_zip(arguments(F.col("call")).alias("argument"), parameters(F.col("signature")).alias("parameter"))
    each = calls.select("caller", "callee", F.posexplode(zipped).alias("pos", "z"))
    return each.where("z.argument is not null and z.parameter is not null").select("caller", "callee", "pos", "z.argument", "z.parameter").distinct()


def return_flow(calls: DataFrame) -> DataFrame:
    """(callee, caller, value) of what the callees of ``calls`` (caller, callee, code) return."""
    values = F.regexp_extract_all("code", F.lit(r"\breturn[ \t]+([^;\n]+)"), 1)
    return calls.select("callee", "caller", F.explode(F.array_distinct(values)).alias("value")).select("callee", "caller", F.trim("value").alias("value")).distinct()


def field_flow(functions: DataFrame) -> DataFrame:
    """(writer, reader, owner, field): functions of one class of which one writes a field that the other reads.

    ``functions`` has id, owner (the class) and code. A function that reads what it
    writes itself isn't linked to itself.
    """
    own = r"\b(?:self|this)\.(\w+)"
    written = F.array_distinct(F.regexp_extract_all("code", F.lit(own + r"[ \t]*=(?:[^=]|$)"), 1))
    reads = F.array_distinct(F.regexp_extract_all(F.regexp_replace("code", own + r"[ \t]*=(?:[^=]|$)", " "), F.lit(own + r"\b"), 1))
    w = functions.select(F.col("id").alias("writer"), "owner", F.explode(written).alias("field"))
    r = functions.select(F.col("id").alias("reader"), "owner", F.explode(reads).alias("field"))
    return w.join(r, ["owner", "field"]).where("writer <> reader").select("writer", "reader", "owner", "field").distinct()


def collection_flow(functions: DataFrame) -> DataFrame:
    """(id, source, target): values that go into a collection, and values that come out of one, in each function's code."""
    names = "|".join(sorted(PUTS + TAKES, key=lambda n: (-len(n), n)))
    found = F.regexp_extract_all("code", F.lit(rf"(\b\w+\.(?:{names})\([^()]*\))"), 1)
    each = functions.select("id", F.explode(found).alias("call"))
    receiver, method = F.regexp_extract("call", r"^(\w+)\.(\w+)\(", 1), F.regexp_extract("call", r"^(\w+)\.(\w+)\(", 2)
    put = each.where(method.isin(*PUTS)).select("id", F.explode(arguments(F.col("call"))).alias("source"), receiver.alias("target"))
    taken = each.where(method.isin(*TAKES)).select("id", receiver.alias("source"), F.col("call").alias("target"))
    return put.unionByName(taken).distinct()


def complexity(code: Column) -> Column:
    """1 and one for each branch, loop, handler and boolean operator."""
    words = F.regexp_extract_all(code, F.lit(r"\b(if|elif|for|while|except|catch|case|assert|and|or|with)\b"), 1)
    signs = F.regexp_extract_all(code, F.lit(r"(&&|\|\||\?)"), 1)
    return 1 + F.size(words) + F.size(signs)


def layer(path: Column) -> Column:
    """The layer that a path tells, or other."""
    low = F.lower(path)
    out = F.lit("other")
    for part, name in reversed(LAYERS):
        out = F.when(F.contains(low, F.lit(part)), F.lit(name)).otherwise(out)
    return out


def route(annotation: Column) -> Column:
    """(verb, path) of a mapping annotation; null for others."""
    verb = F.upper(F.regexp_extract(annotation, r"(?i)@?(get|post|put|delete|patch|request)_?(?:mapping)?\s*\(", 1))
    path = F.regexp_extract(annotation, r"[\"']([^\"']*)[\"']", 1)
    return F.when(verb != "", F.struct(F.when(verb == "REQUEST", "ANY").otherwise(verb).alias("verb"), path.alias("path")))


def compress(code: Column, most: int) -> Column:
    """Code without comments, docstrings and long literals, cut at ``most`` characters."""
    bare = F.regexp_replace(code, "(?s:\"\"\".*?\"\"\"|'''.*?'''|/\\*.*?\\*/)", "")
    bare = F.regexp_replace(bare, r"(?m)(?:^|[ \t])(?:#|//)[^\n]*$", "")
    bare = F.regexp_replace(bare, r"\"[^\"\n]{40,}\"", '"..."')
    bare = F.trim(F.regexp_replace(bare, r"[ \t]*\n(?:[ \t]*\n)+", "\n"))
    return F.when(F.char_length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("..."))).otherwise(bare)


def simple_type(name: Column) -> Column:
    """A type without generics, brackets and qualifier."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"<[^<>]*>", ""), r"<[^<>]*>", ""), r"\[\]|\.\.\.", "")
    return F.regexp_replace(F.trim(bare), r"^.*\.", "")


def classify_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """The calls (id, method, receiver) with the kind of the rule that fits: one with a hint before one without, then in order.

    ``rules`` has no, method, hint and kind. Calls are joined on the method, so a
    table of rules of any size is fine.
    """
    met = calls.join(rules, "method").where((F.col("hint") == "") | F.contains(F.lower("receiver"), F.lower("hint")))
    w = Window.partitionBy("id").orderBy(F.col("hint") == "", "no")
    return met.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "method", "receiver", "kind")


def cards(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, node_name, fqn, callers, callees): each node with the different full names around it, sorted."""
    names = nodes.select("id", "fqn")
    into = calls.join(names.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("fqn")).alias("callers"))
    out = calls.join(names.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("fqn")).alias("callees"))
    none = F.array().cast("array<string>")
    return (
        nodes.join(into, "id", "left")
        .join(out, "id", "left")
        .select("id", "node_name", "fqn", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))
    )


def paths_or_expanded(edges: DataFrame, more: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, id, depth, expanded) of what seeds reach; seeds that reach nothing try again with ``more`` edges, too."""
    first = traversal.reach(edges, seeds, max_depth).where("depth > 0")
    alone = seeds.join(first.select(F.col("seed").alias("id")).distinct(), "id", "left_anti")
    again = traversal.reach(edges.select("src", "dst").unionByName(more.select("src", "dst")), alone, max_depth).where("depth > 0")
    return first.select("seed", "id", "depth", F.lit(False).alias("expanded")).unionByName(again.select("seed", "id", "depth", F.lit(True).alias("expanded")))


def cascade(tiers: list[DataFrame], key: str) -> DataFrame:
    """The rows of the first tier that has any for a key."""
    out = None
    for tier in tiers:
        if out is not None:
            tier = tier.join(out.select(key).distinct(), key, "left_anti")
        out = tier if out is None else out.unionByName(tier)
    return out


def words_of_name(name: Column) -> Column:
    """The words of a camel-case or snake-case name."""
    return T.tokens(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), "_", " "))
