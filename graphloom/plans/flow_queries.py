"""Queries of flow, context and search over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import codeflow as X
from graphloom.operators import retrieval as R
from graphloom.operators import traversal
from graphloom.plans.catalog import EDGES_SQL, NODES_SQL, Catalog
from graphloom.sources.graph_tables import code_edges, code_nodes
from graphloom.session import table

catalog = Catalog()
_F = "('function_definition', 'method_declaration', 'method_definition')"
_IS_F = f"node_type in {_F}"
_C = f"{EDGES_SQL}, c AS (SELECT src, dst FROM e WHERE edge_type = 'CALLS')"


def _functions(spark, sf_dir, *columns):
    return code_nodes(spark, sf_dir, "node_type", *columns).where(_IS_F)


_CARDS_SQL = f"""{_C}, i AS (SELECT c.dst AS id, list_sort(list(DISTINCT fqn)) AS names FROM c JOIN n ON n.id = c.src WHERE fqn IS NOT NULL GROUP BY 1),
o AS (SELECT c.src AS id, list_sort(list(DISTINCT fqn)) AS names FROM c JOIN n ON n.id = c.dst WHERE fqn IS NOT NULL GROUP BY 1),
cards AS (SELECT n.id, node_name, fqn, coalesce(i.names, []) AS callers, coalesce(o.names, []) AS callees FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id) WHERE node_type IN {_F})"""


@catalog.query(f"WITH {_CARDS_SQL} SELECT id, node_name, fqn, array_to_string(callers, ',') AS callers, array_to_string(callees, ',') AS callees FROM cards")
def code_context_card(spark, sf_dir):
    """Each function with the full names of its callers and callees."""
    nodes = code_nodes(spark, sf_dir, "node_type", "node_name", "fqn")
    cards = X.cards(nodes, code_edges(spark, sf_dir, "CALLS").select("src", "dst"))
    cards = cards.join(nodes.where(_IS_F).select("id"), "id", "left_semi")
    return cards.select("id", "node_name", "fqn", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@catalog.query(
    f"""WITH {_CARDS_SQL} SELECT id, node_name || ' is called by ' || len(callers) || ' and calls ' || len(callees) || CASE WHEN len(callees) > 0 THEN ' (' || array_to_string(callees[:3], ', ') || ')' ELSE '' END AS summary FROM cards WHERE node_name IS NOT NULL"""
)
def explain_code(spark, sf_dir):
    nodes = code_nodes(spark, sf_dir, "node_type", "node_name", "fqn")
    cards = X.cards(nodes, code_edges(spark, sf_dir, "CALLS").select("src", "dst")).join(nodes.where(_IS_F).select("id"), "id", "left_semi")
    some = F.when(F.size("callees") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("callees", 1, 3), ", "), F.lit(")"))).otherwise("")
    summary = F.concat(F.format_string("%s is called by %d and calls %d", "node_name", F.size("callers"), F.size("callees")), some)
    return cards.where("node_name is not null").select("id", summary.alias("summary"))


@catalog.query(
    f"""WITH RECURSIVE {_C}, p AS (SELECT src, dst FROM e WHERE edge_type = 'PARENT_OF'), d AS (SELECT n.id AS fn, n.id AS node, 0 AS depth FROM n WHERE node_type IN {_F} UNION SELECT d.fn, p.dst, d.depth + 1 FROM d JOIN p ON p.src = d.node WHERE d.depth < 6),
x AS (SELECT DISTINCT d.fn, n.id, n.node_type, coalesce(n.node_name, n.code) AS name FROM d JOIN n ON n.id = d.node WHERE d.depth > 0),
k AS (SELECT fn, name, row_number() OVER (PARTITION BY fn ORDER BY name) AS r FROM (SELECT DISTINCT fn, name FROM x WHERE node_type = 'identifier' AND name IS NOT NULL))
SELECT n.id, coalesce(a.callers, 0) AS n_callers, coalesce(b.callees, 0) AS n_callees, coalesce(v.names, '') AS identifiers, coalesce(w.n, 0) AS n_assigned FROM n
LEFT JOIN (SELECT dst AS id, count(*) AS callers FROM c GROUP BY 1) a USING (id) LEFT JOIN (SELECT src AS id, count(*) AS callees FROM c GROUP BY 1) b USING (id)
LEFT JOIN (SELECT fn AS id, string_agg(name, ',' ORDER BY name) AS names FROM k WHERE r <= 50 GROUP BY 1) v USING (id)
LEFT JOIN (SELECT fn AS id, count(DISTINCT id) AS n FROM x WHERE node_type = 'assignment' GROUP BY 1) w USING (id) WHERE n.node_type IN {_F}"""
)
def function_analysis(spark, sf_dir):
    """Callers, callees, the first fifty identifiers below a function and its assignments, down to six levels."""
    nodes = code_nodes(spark, sf_dir, "node_type", "node_name", "code")
    functions = nodes.where(_IS_F).select("id")
    calls = code_edges(spark, sf_dir, "CALLS").select("src", "dst")
    inner = nodes.where("node_type in ('identifier', 'assignment')").select(F.col("id").alias("node"), "node_type", F.coalesce("node_name", "code").alias("name"))
    below = traversal.reach(code_edges(spark, sf_dir, "PARENT_OF"), functions, 6).where("depth > 0").select("seed", F.col("id").alias("node"))
    held = below.join(inner, "node")
    names = R.top_k(held.where("node_type = 'identifier' and name is not null").select("seed", "name").distinct(), ["seed"], [F.col("name")], 50)
    listed = names.groupBy(F.col("seed").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("identifiers"))
    assigned = held.where("node_type = 'assignment'").groupBy(F.col("seed").alias("id")).agg(F.count_distinct("node").alias("n_assigned"))
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_callers"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_callees"))
    rows = functions.join(into, "id", "left").join(out, "id", "left").join(listed, "id", "left").join(assigned, "id", "left")
    return rows.fillna(0, ["n_callers", "n_callees", "n_assigned"]).fillna("", ["identifiers"]).select("id", "n_callers", "n_callees", "identifiers", "n_assigned")


def _flow_sql(kind: str) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, g AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = '{kind}'), s AS (SELECT DISTINCT src AS id FROM g WHERE src NOT IN (SELECT dst FROM g)),
r AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT r.seed, g.dst, r.depth + 1 FROM r JOIN g ON g.src = r.id WHERE r.depth < 5)
SELECT seed, id AS target, min(depth) AS hops FROM r WHERE depth > 0 GROUP BY 1, 2 HAVING target <> seed"""


def _flow(spark, sf_dir, kind):
    edges = code_edges(spark, sf_dir, kind).select("src", "dst")
    heads = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    return traversal.reach(edges, heads, 5).where("depth > 0").select("seed", F.col("id").alias("target"), F.col("depth").alias("hops"))


@catalog.query(_flow_sql("REACHES"))
def data_flow_paths(spark, sf_dir):
    """The values that each first value reaches within five steps of data flow, with the fewest steps."""
    return _flow(spark, sf_dir, "REACHES")


@catalog.query(_flow_sql("FLOWS_TO"))
def control_flow_paths(spark, sf_dir):
    return _flow(spark, sf_dir, "FLOWS_TO")


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, g AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = 'REACHES'), h AS (SELECT src, dst FROM g UNION SELECT src, dst FROM e WHERE edge_type = 'FLOWS_TO'), s AS (SELECT DISTINCT src AS id FROM h),
a AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT a.seed, g.dst, a.depth + 1 FROM a JOIN g ON g.src = a.id WHERE a.depth < 3),
f AS (SELECT seed, id, min(depth) AS depth FROM a WHERE depth > 0 AND id <> seed GROUP BY 1, 2),
b AS (SELECT id AS seed, id, 0 AS depth FROM s WHERE id NOT IN (SELECT seed FROM f) UNION SELECT b.seed, h.dst, b.depth + 1 FROM b JOIN h ON h.src = b.id WHERE b.depth < 3)
SELECT seed, id, depth, false AS expanded FROM f UNION ALL SELECT seed, id, min(depth), true FROM b WHERE depth > 0 AND id <> seed GROUP BY 1, 2"""
)
def flow_with_expansion(spark, sf_dir):
    """Data flow within three steps; a start that reaches nothing tries again with the edges of control flow."""
    data = code_edges(spark, sf_dir, "REACHES").select("src", "dst")
    control = code_edges(spark, sf_dir, "FLOWS_TO").select("src", "dst")
    seeds = data.unionByName(control).select(F.col("src").alias("id")).distinct()
    return X.paths_or_expanded(data, control, seeds, 3)


_PARAMS = """list_filter(list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_extract(signature, '\\(([^()]*)\\)', 1), '<[^<>]*>', '', 'g'), ','), lambda p: trim(p)), lambda p: p <> ''),
lambda p: regexp_extract(regexp_replace(p, '\\s*[:=].*$', ''), '([\\w$]+)$', 1)), lambda p: p NOT IN ('', 'self', 'cls'))"""
_ARGS = "list_filter(list_transform(string_split(regexp_extract(call, '\\(([^()]*)\\)', 1), ','), lambda a: trim(a)), lambda a: a <> '')"


@catalog.query(
    f"""WITH {_C}, s AS (SELECT c.src AS caller, c.dst AS callee, d.signature, unnest(regexp_extract_all(s.code, '(\\b' || d.node_name || '\\([^()]*\\))', 1)) AS call FROM c JOIN n s ON s.id = c.src JOIN n d ON d.id = c.dst WHERE s.code IS NOT NULL AND regexp_matches(d.node_name, '^\\w+$')),
z AS (SELECT caller, callee, {_ARGS} AS a, {_PARAMS} AS p FROM s WHERE signature IS NOT NULL), y AS (SELECT caller, callee, unnest(range(least(len(a), len(p)))) AS pos, a, p FROM z)
SELECT DISTINCT caller, callee, pos, a[pos + 1] AS argument, p[pos + 1] AS parameter FROM y"""
)
def argument_flow(spark, sf_dir):
    """The values that calls hand to parameters, read from the code of the caller and the signature of the callee."""
    nodes = code_nodes(spark, sf_dir, "node_name", "signature", "code")
    calls = code_edges(spark, sf_dir, "CALLS").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    s = nodes.where("code is not null").select(F.col("id").alias("caller"), "code")
    d = nodes.where("signature is not null").where(F.col("node_name").rlike(r"^\w+$")).select(F.col("id").alias("callee"), "node_name", "signature")
    places = F.expr(r"regexp_extract_all(code, concat('(\\b', node_name, '\\([^()]*\\))'), 1)")
    return X.argument_flow(calls.join(s, "caller").join(d, "callee").select("caller", "callee", "signature", F.explode(places).alias("call")))


@catalog.query(
    f"""WITH {_C}, v AS (SELECT c.dst AS callee, c.src AS caller, unnest(regexp_extract_all(d.code, '\\breturn[ \\t]+([^;\\n]+)', 1)) AS value FROM c JOIN n d ON d.id = c.dst WHERE d.code IS NOT NULL)
SELECT DISTINCT callee, caller, trim(value) AS value FROM v"""
)
def return_flow(spark, sf_dir):
    code = code_nodes(spark, sf_dir, "code").where("code is not null").select(F.col("id").alias("callee"), "code")
    calls = code_edges(spark, sf_dir, "CALLS").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return X.return_flow(calls.join(code, "callee"))


_OWN = "\\b(?:self|this)\\.(\\w+)"


@catalog.query(
    f"""WITH {NODES_SQL}, f AS (SELECT id, regexp_replace(fqn, '\\.[^.]*$', '') AS owner, code FROM n WHERE node_type IN {_F} AND fqn IS NOT NULL AND code IS NOT NULL),
w AS (SELECT DISTINCT id, owner, unnest(regexp_extract_all(code, '{_OWN}[ \\t]*=(?:[^=]|$)', 1)) AS field FROM f), r AS (SELECT DISTINCT id, owner, unnest(regexp_extract_all(regexp_replace(code, '{_OWN}[ \\t]*=(?:[^=]|$)', ' ', 'g'), '{_OWN}\\b', 1)) AS field FROM f)
SELECT w.id AS writer, r.id AS reader, owner, field FROM w JOIN r USING (owner, field) WHERE w.id <> r.id"""
)
def field_flow(spark, sf_dir):
    """Methods of a class that write a field, with those that read it."""
    rows = _functions(spark, sf_dir, "fqn", "code").where("fqn is not null and code is not null")
    return X.field_flow(rows.select("id", F.regexp_replace("fqn", r"\.[^.]*$", "").alias("owner"), "code"))


_PUT, _TAKE = ", ".join(f"'{x}'" for x in X.PUTS), ", ".join(f"'{x}'" for x in X.TAKES)
_BOTH = "|".join(sorted(X.PUTS + X.TAKES, key=lambda n: (-len(n), n)))


@catalog.query(
    f"""WITH k AS (SELECT id, unnest(regexp_extract_all(code, '(\\b\\w+\\.(?:{_BOTH})\\([^()]*\\))', 1)) AS call FROM (SELECT DISTINCT file_id AS id, code FROM source_files WHERE code IS NOT NULL)),
m AS (SELECT id, call, regexp_extract(call, '^(\\w+)\\.(\\w+)\\(', 1) AS receiver, regexp_extract(call, '^(\\w+)\\.(\\w+)\\(', 2) AS method FROM k)
SELECT id, source, target FROM (SELECT id, unnest({_ARGS}) AS source, receiver AS target FROM m WHERE method IN ({_PUT})) UNION SELECT id, receiver, call FROM m WHERE method IN ({_TAKE})"""
)
def collection_flow(spark, sf_dir):
    files = table(spark, sf_dir, "source_files").where("code is not null").select(F.col("file_id").alias("id"), "code").distinct()
    return X.collection_flow(files)


@catalog.query(
    f"""WITH {NODES_SQL} SELECT id, complexity AS given, 1 + len(regexp_extract_all(code, '\\b(if|elif|for|while|except|catch|case|assert|and|or|with)\\b')) + len(regexp_extract_all(code, '(&&|\\|\\||\\?)')) AS counted,
CASE {" ".join(f"WHEN contains(lower(file_path), '{a}') THEN '{b}'" for a, b in X.LAYERS)} ELSE 'other' END AS layer FROM n WHERE node_type IN {_F} AND code IS NOT NULL"""
)
def code_measures(spark, sf_dir):
    """The complexity of each function, as stored and as counted, and the layer that its path tells."""
    rows = _functions(spark, sf_dir, "complexity", "code", "file_path").where("code is not null")
    return rows.select("id", F.col("complexity").alias("given"), X.complexity(F.col("code")).alias("counted"), X.layer(F.coalesce("file_path", F.lit(""))).alias("layer"))


@catalog.query(
    r"""WITH s AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(code, '(@[A-Za-z]+ *\([^()\n]*\))', 1)) AS a FROM source_files WHERE code IS NOT NULL), p AS (SELECT file_id, a, upper(regexp_extract(a, '(?i)@?(get|post|put|delete|patch|request)_?(?:mapping)?\s*\(', 1)) AS verb FROM s)
SELECT file_id, a AS annotation, CASE WHEN verb = 'REQUEST' THEN 'ANY' ELSE nullif(verb, '') END AS verb, CASE WHEN verb <> '' THEN regexp_extract(a, '["'']([^"'']*)["'']', 1) END AS path FROM p"""
)
def routes(spark, sf_dir):
    """The annotations with arguments in source files, and the routes that some of them map."""
    rows = table(spark, sf_dir, "source_files").where("code is not null")
    each = rows.select("file_id", F.explode(F.regexp_extract_all("code", F.lit(r"(@[A-Za-z]+ *\([^()\n]*\))"), 1)).alias("annotation")).distinct()
    found = X.route(F.col("annotation"))
    return each.select("file_id", "annotation", found["verb"].alias("verb"), found["path"].alias("path"))


@catalog.query(
    rf"""WITH {NODES_SQL}, a AS (SELECT id, regexp_replace(source_code, '(?s:"{{3}}.*?"{{3}}|''{{3}}.*?''{{3}}|/\*.*?\*/)', '', 'g') AS b FROM n WHERE source_code IS NOT NULL),
c AS (SELECT id, regexp_replace(regexp_replace(b, '(?m)(?:^|[ \t])(?:#|//)[^\n]*$', '', 'g'), '"[^"\n]{{40,}}"', '"..."', 'g') AS b FROM a), d AS (SELECT id, trim(regexp_replace(b, '[ \t]*\n(?:[ \t]*\n)+', chr(10), 'g')) AS b FROM c)
SELECT id, CASE WHEN length(b) > 400 THEN substr(b, 1, 400) || '...' ELSE b END AS code FROM d"""
)
def compressed_code(spark, sf_dir):
    rows = code_nodes(spark, sf_dir, "source_code").where("source_code is not null")
    return rows.select("id", X.compress(F.col("source_code"), 400).alias("code"))


@catalog.query(
    rf"""WITH {NODES_SQL} SELECT id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(t, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '\[\]|\.\.\.', '', 'g')), '^.*\.', '') AS type FROM (
SELECT id, regexp_extract(signature, '^(?:(?:public|private|protected|static|final) )*([^()]+) \w+\(', 1) AS t FROM n WHERE node_type = 'method_declaration' AND signature IS NOT NULL) WHERE t <> ''"""
)
def return_types(spark, sf_dir):
    rows = code_nodes(spark, sf_dir, "node_type", "signature").where("node_type = 'method_declaration'")
    t = F.regexp_extract("signature", r"^(?:(?:public|private|protected|static|final) )*([^()]+) \w+\(", 1)
    return rows.select("id", t.alias("t")).where("t <> ''").select("id", X.simple_type(F.col("t")).alias("type"))


_RULES_SQL = ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(X.SECURITY_RULES))


@catalog.query(
    f"""WITH rules(no, method, hint, kind) AS (VALUES {_RULES_SQL}), k AS (SELECT DISTINCT file_id AS id, unnest(regexp_extract_all(code, '(\\w+\\.\\w+)\\(', 1)) AS call FROM source_files WHERE code IS NOT NULL),
c AS (SELECT id || ':' || call AS id, split_part(call, '.', 2) AS method, split_part(call, '.', 1) AS receiver FROM k)
SELECT id, method, receiver, kind FROM c JOIN rules USING (method) WHERE hint = '' OR contains(lower(receiver), lower(hint)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY hint = '', no) = 1"""
)
def security_calls(spark, sf_dir):
    """The calls that a rule names as source, sink or sanitizer."""
    found = table(spark, sf_dir, "source_files").where("code is not null").select(F.col("file_id").alias("id"), "code")
    calls = found.select("id", F.explode(F.regexp_extract_all("code", F.lit(r"(\w+\.\w+)\("), 1)).alias("call")).distinct()
    parts = F.split("call", r"\.")
    calls = calls.select(F.concat_ws(":", "id", "call").alias("id"), parts[1].alias("method"), parts[0].alias("receiver"))
    rules = spark.createDataFrame([(k, *r) for k, r in enumerate(X.SECURITY_RULES)], "no int, method string, hint string, kind string")
    return X.classify_calls(calls, rules)


@catalog.query(
    f"""WITH {NODES_SQL}, q AS (SELECT DISTINCT lower(title) AS query, string_split(lower(title), ' ') AS words FROM documents WHERE title IS NOT NULL),
k AS (SELECT id, node_name, lower(node_name) AS name, regexp_extract_all(lower(replace(regexp_replace(node_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '([\\p{{L}}\\p{{N}}_]+)', 1) AS words FROM n WHERE node_type = 'class_definition' AND node_name IS NOT NULL),
t1 AS (SELECT query, id, 1 AS tier, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM q JOIN k ON k.name = replace(q.query, ' ', '')),
w AS (SELECT DISTINCT query, unnest(words) AS word FROM q), kw AS (SELECT DISTINCT id, unnest(words) AS word FROM k), m AS (SELECT query, id, count(*) AS hits FROM w JOIN kw USING (word) GROUP BY 1, 2),
t2 AS (SELECT query, id, 2 AS tier, row_number() OVER (PARTITION BY query ORDER BY hits DESC, id) AS rank FROM m WHERE query NOT IN (SELECT query FROM t1 WHERE rank <= 5))
SELECT query, id, tier, rank FROM t1 WHERE rank <= 5 UNION ALL SELECT query, id, tier, rank FROM t2 WHERE rank <= 3"""
)
def code_retrieval(spark, sf_dir):
    """Classes for each title: up to five of that very name, else three that share most words with it."""
    titles = table(spark, sf_dir, "documents").where("title is not null").select(F.lower("title").alias("query")).distinct()
    classes = code_nodes(spark, sf_dir, "node_type", "node_name").where("node_type = 'class_definition' and node_name is not null")
    exact = titles.withColumn("name", F.replace("query", F.lit(" "), F.lit(""))).join(classes.select("id", F.lower("node_name").alias("name")), "name")
    first = R.top_k(exact.select("query", "id", F.lit(1).alias("tier")), ["query"], [F.col("id")], 5)
    asked = titles.select("query", F.explode(F.array_distinct(F.split("query", " "))).alias("word"))
    named = classes.select("id", F.explode(F.array_distinct(X.words_of_name(F.col("node_name")))).alias("word"))
    shared = asked.join(named, "word").groupBy("query", "id").agg(F.count("*").alias("hits"), F.lit(2).alias("tier"))
    second = R.top_k(shared, ["query"], [F.desc("hits"), F.col("id")], 3)
    return X.cascade([first.select("query", "id", "tier", "rank"), second.select("query", "id", "tier", "rank")], "query")


@catalog.query(
    f"""WITH {_C}, k AS (SELECT id, len(regexp_extract_all(lower(coalesce(code, '')), 'node_|load|index')) AS hits FROM n WHERE node_type IN {_F}), top AS (SELECT id, hits FROM k WHERE hits > 0 ORDER BY hits DESC, id LIMIT 3)
SELECT top.id, hits, 'calls' AS link, c.dst AS other FROM top JOIN c ON c.src = top.id UNION ALL SELECT top.id, hits, 'called by', c.src FROM top JOIN c ON c.dst = top.id"""
)
def agent_steps(spark, sf_dir):
    """A search for three functions and the functions one call away from each of them."""
    hits = F.size(F.regexp_extract_all(F.lower(F.coalesce("code", F.lit(""))), F.lit("(node_|load|index)"), 1))
    top = _functions(spark, sf_dir, "code").select("id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(3)
    calls = code_edges(spark, sf_dir, "CALLS")
    out = top.join(calls.select(F.col("src").alias("id"), F.col("dst").alias("other")), "id").select("id", "hits", F.lit("calls").alias("link"), "other")
    into = top.join(calls.select(F.col("dst").alias("id"), F.col("src").alias("other")), "id").select("id", "hits", F.lit("called by").alias("link"), "other")
    return out.unionByName(into)


@catalog.query(
    f"""WITH {_C}, i AS (SELECT dst AS id, count(*) AS callers FROM c GROUP BY 1) SELECT n.id, node_name, coalesce(callers, 0) AS callers FROM n LEFT JOIN i USING (id)
WHERE node_type IN {_F} AND starts_with(node_name, 'load') ORDER BY coalesce(callers, 0) DESC, n.id LIMIT 100"""
)
def hot_methods(spark, sf_dir):
    """The hundred most called functions of a name, to be expanded first."""
    into = code_edges(spark, sf_dir, "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    rows = _functions(spark, sf_dir, "node_name").where("startswith(node_name, 'load')").select("id", "node_name")
    return rows.join(into, "id", "left").fillna(0, ["callers"]).orderBy(F.desc("callers"), "id").limit(100)


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, g AS (SELECT DISTINCT src, dst FROM e WHERE edge_type IN ('IMPLEMENTS', 'DEPENDS_ON') AND src <> dst), s AS (SELECT src AS id FROM g UNION SELECT dst FROM g),
r AS (SELECT id AS a, id AS b, 0 AS d FROM s UNION SELECT r.a, g.dst, r.d + 1 FROM r JOIN g ON g.src = r.b WHERE r.d < 4)
SELECT d AS length, count(*) AS pairs FROM (SELECT a, b, min(d) AS d FROM r GROUP BY 1, 2) WHERE d > 0 GROUP BY 1"""
)
def path_lengths(spark, sf_dir):
    """How many pairs of files and classes lie how many steps apart, up to four."""
    edges = code_edges(spark, sf_dir, "IMPLEMENTS", "DEPENDS_ON").where("src <> dst").select("src", "dst").distinct()
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return traversal.reach(edges, ends, 4).where("depth > 0").groupBy(F.col("depth").alias("length")).agg(F.count("*").alias("pairs"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
