"""Queries on syntax trees and statements, with their SQL as recursive queries over parents.

The trees are made from ``lineitem``: each part is a unit, its rows are the nodes in
order of their keys, every third can have children, and a node's parent is an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators import graphs as G
from tracewell.operators import syntax as X
from tracewell.plans.contracts import pick, sql_pick
from tracewell.plans.registry import collector
from tracewell.plans.traces import read

QUERIES, ORACLE_SQL, query = collector()

INNER = ("if", "while", "switch", "label", "if", "do", "for")
LEAVES = ("expr", "return", "break", "continue", "goto", "case", "default", "expr", "case", "expr")
CONDITIONS = ("x == 1", "!(y)", "a->b", "LIMIT < x", "!x", "f(x)", "", "x != y", "y")
VALUES = ("0", "1", "2 | 3", "MAX", "1")
ABOVE = ("binary", "paren", "unary", "binary", "other")
ASSIGNED = ("*p = 1", "(*p) |= x", "*q == 2", "a + b", "*(r) = *p", " *q <<= 3")
DEREFS = ("*p", "(*p)", "*q", "*(r)")

_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"
_HASH = "(l_orderkey * 31 + l_linenumber * 7 + l_suppkey * 13 + i * 17)"
_PARENT = "CASE WHEN i = 0 OR h % 5 = 0 THEN NULL ELSE 3 * ((h {div} 7) % ((i + 2) {div} 3)) END"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, node, ord, h, parent): the shape of the trees."""
    order = Window.partitionBy("l_partkey").orderBy(*_ORDER.split(", "))
    df = read(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(order).cast("long") - 1).withColumn("h", F.expr(_HASH))
    return df.select(F.col("l_partkey").alias("unit"), F.col("i").alias("node"), F.col("i").alias("ord"), "h", F.expr(_PARENT.format(div="div")).alias("parent"))


_PLACED_SQL = f"""placed AS (SELECT unit, i AS node, h, {_PARENT.format(div='//')} AS parent
 FROM (SELECT *, {_HASH} AS h FROM (SELECT l_partkey AS unit, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) - 1 AS i FROM lineitem)))"""


def _text(inner: str, pickers) -> str:
    return f"""CASE WHEN kind IN ('if', 'while', 'do', 'for') THEN {pickers(CONDITIONS, f'h {inner} 3')} WHEN kind = 'switch' THEN {pickers(('x', 's->m', 'y'), f'h {inner} 3')}
 WHEN kind = 'label' THEN concat('L', node) WHEN kind = 'goto' THEN concat('L', 3 * ((h {inner} 11) % 10)) WHEN kind = 'case' THEN {pickers(VALUES, f'h {inner} 5')} END"""


def _spark_pick(values, index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast(({index}) % {len(values)} AS int) + 1)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, node, ord, parent, branch, kind, text): the statements of one function a unit."""
    kind = F.when(F.col("node") % 3 == 0, pick(INNER, "h")).otherwise(pick(LEAVES, "h"))
    df = _placed(spark, sf_dir).withColumn("kind", kind).withColumn("text", F.expr(_text("div", _spark_pick)))
    above = df.select("unit", F.col("node").alias("parent"), F.col("kind").alias("above"))
    branch = F.when(F.col("above") == "if", F.when(F.col("h") % 2 == 0, "then").otherwise("else")).when(F.col("above").isNotNull(), "body")
    return df.join(above, ["unit", "parent"], "left").select("unit", "node", "ord", "parent", branch.alias("branch"), "kind", "text")


_STATEMENTS_SQL = f"""{_PLACED_SQL}, kinds AS (SELECT *, CASE WHEN node % 3 = 0 THEN {sql_pick(INNER, 'h')} ELSE {sql_pick(LEAVES, 'h')} END AS kind FROM placed),
st AS (SELECT a.unit, a.node, a.parent, CASE WHEN b.kind = 'if' THEN CASE WHEN a.h % 2 = 0 THEN 'then' ELSE 'else' END WHEN b.kind IS NOT NULL THEN 'body' END AS branch, a.kind, a.text, b.kind AS pk, b.text AS pt
 FROM (SELECT *, {_text('//', sql_pick)} AS text FROM kinds) a LEFT JOIN (SELECT *, {_text('//', sql_pick)} AS text FROM kinds) b ON b.unit = a.unit AND b.node = a.parent)"""

#: Top-down: the path of each node, which sorts as pre-order, and all pairs of a node and one above it.
_TREE_SQL = """down AS (SELECT unit, node, [node] AS path FROM {0} WHERE parent IS NULL UNION ALL SELECT c.unit, c.node, list_append(d.path, c.node) FROM {0} c JOIN down d ON d.unit = c.unit AND d.node = c.parent),
pre AS (SELECT unit, node, len(path) - 1 AS depth, path, row_number() OVER (PARTITION BY unit ORDER BY path) - 1 AS pre FROM down),
up AS (SELECT unit, node, unnest(path) AS above, unnest(range(0, len(path))) AS at, depth FROM pre),
ends AS (SELECT p.unit, p.node, p.pre, p.depth, p.pre + (SELECT count(*) FROM up u WHERE u.unit = p.unit AND u.above = p.node) - 1 AS last FROM pre p)"""


@query(f"WITH RECURSIVE {_PLACED_SQL}, {_TREE_SQL.format('placed')} SELECT unit, node, pre, CAST(last AS BIGINT) AS last, CAST(depth AS INT) AS depth FROM ends")
def syntax_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.intervals(_placed(spark, sf_dir), "unit").select("unit", "node", "pre", "last", "depth")


@query(f"""WITH RECURSIVE {_PLACED_SQL}, t AS (SELECT *, CASE WHEN node % 3 = 0 THEN {sql_pick(ABOVE, 'h')} ELSE 'deref' END AS kind FROM placed),
n AS (SELECT *, CASE kind WHEN 'binary' THEN {sql_pick(ASSIGNED, 'h // 5')} WHEN 'unary' THEN {sql_pick(('(*p)++', '-x', '--*q'), 'h // 5')} WHEN 'deref' THEN {sql_pick(DEREFS, 'h // 5')} ELSE '' END AS text FROM t), {_TREE_SQL.format('n')},
lhs AS (SELECT *, trim(regexp_extract(trim(text), '(?s)^(.+?)\\s*(<<=|>>=|\\+=|-=|\\|=|&=|\\^=|=)([^=]|$)', 1), '()') AS l FROM n WHERE kind = 'binary')
SELECT d.unit, d.node, CASE WHEN EXISTS (SELECT 1 FROM up u JOIN lhs b ON b.unit = u.unit AND b.node = u.above WHERE u.unit = d.unit AND u.node = d.node AND u.above <> u.node AND b.l <> '' AND b.l = trim(d.text, '()')) THEN 'write'
 WHEN EXISTS (SELECT 1 FROM up u JOIN n b ON b.unit = u.unit AND b.node = u.above WHERE u.unit = d.unit AND u.node = d.node AND u.above <> u.node AND u.depth - u.at <= 2 AND (b.text LIKE '%++%' OR b.text LIKE '%--%')) THEN 'rmw' ELSE 'read' END AS access_kind
FROM n d WHERE kind = 'deref'""")
def ancestor_access_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("node") % 3 == 0, pick(ABOVE, "h")).otherwise("deref")
    nodes = _placed(spark, sf_dir).withColumn("kind", kind)
    text = F.when(F.col("kind") == "binary", pick(ASSIGNED, "h div 5")).when(F.col("kind") == "unary", pick(("(*p)++", "-x", "--*q"), "h div 5")).when(F.col("kind") == "deref", pick(DEREFS, "h div 5")).otherwise("")
    return X.ancestor_access_kind(X.intervals(nodes.withColumn("text", text), "unit"), "unit")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.intervals(statements(spark, sf_dir), "unit")


#: Frames: what governs the nodes below (and, of loops, the node itself).
_FRAMES_SQL = """cases AS (SELECT unit, parent, list_distinct_ordered AS vals FROM (SELECT unit, parent, list(v ORDER BY o) AS list_distinct_ordered FROM (SELECT unit, parent, v, min(o) AS o FROM (SELECT unit, parent, unnest(string_split(text, ' | ')) AS v, node * 10 + unnest(range(len(string_split(text, ' | ')))) AS o FROM st WHERE kind = 'case' AND pk = 'switch') GROUP BY ALL) GROUP BY ALL)),
marks AS (SELECT *, (SELECT max(node) FROM st m WHERE m.unit = s.unit AND m.parent = s.parent AND m.node < s.node AND m.kind IN ('case', 'default', 'break')) AS mk FROM st s WHERE pk = 'switch'),
scopes AS (
 SELECT unit, node, 'cond' AS kind, CASE branch WHEN 'then' THEN pt ELSE '!(' || pt || ')' END AS guard, branch FROM st WHERE pk = 'if' AND pt <> ''
 UNION ALL SELECT unit, node, 'loop', text, kind FROM st WHERE kind IN ('for', 'while', 'do') AND text <> ''
 UNION ALL SELECT a.unit, a.node, 'cond', CASE m.kind WHEN 'case' THEN array_to_string(list_transform(string_split(m.text, ' | '), lambda v: '((' || a.pt || ') == (' || v || '))'), ' || ')
   ELSE CASE WHEN c.vals IS NULL THEN '1' ELSE '!(' || array_to_string(list_transform(c.vals, lambda v: '((' || a.pt || ') == (' || v || '))'), ' || ') || ')' END END, m.kind
  FROM marks a JOIN st m ON m.unit = a.unit AND m.node = a.mk LEFT JOIN cases c ON c.unit = a.unit AND c.parent = a.parent WHERE a.kind NOT IN ('case', 'default') AND m.kind IN ('case', 'default')),
stacks AS (SELECT u.unit, u.node, list({'kind': s.kind, 'guard': s.guard, 'branch': s.branch} ORDER BY u.at, s.kind) AS frames FROM up u JOIN scopes s ON s.unit = u.unit AND s.node = u.above GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_STATEMENTS_SQL}, {_TREE_SQL.format('st')}, {_FRAMES_SQL}
SELECT s.unit, s.node, coalesce(array_to_string(list_transform(frames, lambda f: f.kind || '/' || f.branch || '/' || f.guard), '; '), '') AS frames FROM st s LEFT JOIN stacks k ON k.unit = s.unit AND k.node = s.node WHERE s.kind IN ('expr', 'goto')""")
def control_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = X.control_frames(labelled(spark, sf_dir), "unit", F.col("kind").isin("expr", "goto"))
    return got.select("unit", "node", F.array_join(F.transform("frames", lambda f: F.concat_ws("/", f["kind"], f["branch"], f["guard"])), "; ").alias("frames"))


_EDGES_SQL = """sib AS (SELECT *, lead(node) OVER (PARTITION BY unit, parent, branch ORDER BY node) AS beside FROM st),
walk AS (SELECT unit, node, kind, text, coalesce(beside, -2) AS nxt, NULL::BIGINT AS brk, NULL::BIGINT AS cont FROM sib WHERE parent IS NULL
 UNION ALL SELECT c.unit, c.node, c.kind, c.text, coalesce(c.beside, CASE WHEN w.kind IN ('for', 'while', 'do') THEN w.node ELSE w.nxt END), CASE WHEN w.kind IN ('for', 'while', 'do', 'switch') THEN w.nxt ELSE w.brk END, CASE WHEN w.kind IN ('for', 'while', 'do') THEN w.node ELSE w.cont END
 FROM sib c JOIN walk w ON w.unit = c.unit AND w.node = c.parent),
kid AS (SELECT unit, parent AS node, min(node) FILTER (branch = 'then') AS t, min(node) FILTER (branch = 'else') AS e, min(node) FILTER (branch = 'body') AS b FROM st GROUP BY ALL),
full_ AS (SELECT w.*, t, e, b, CASE WHEN w.kind = 'goto' THEN l.node END AS l, lp.pre AS lpre, p.pre FROM walk w LEFT JOIN kid USING (unit, node) LEFT JOIN st l ON l.unit = w.unit AND l.kind = 'label' AND l.text = w.text AND w.kind = 'goto' LEFT JOIN pre lp ON lp.unit = l.unit AND lp.node = l.node JOIN pre p ON p.unit = w.unit AND p.node = w.node),
edges AS (
 SELECT unit, node AS src, coalesce(t, nxt) AS dst, 'branch-true' AS kind, text AS guard FROM full_ WHERE kind = 'if'
 UNION ALL SELECT unit, node, coalesce(e, nxt), 'branch-false', '!(' || text || ')' FROM full_ WHERE kind = 'if'
 UNION ALL SELECT unit, node, coalesce(b, node), 'loop-body', text FROM full_ WHERE kind IN ('for', 'while', 'do')
 UNION ALL SELECT unit, node, nxt, 'loop-exit', '!(' || text || ')' FROM full_ WHERE kind IN ('for', 'while', 'do')
 UNION ALL SELECT unit, node, coalesce(b, nxt), 'switch-dispatch', text FROM full_ WHERE kind = 'switch'
 UNION ALL SELECT unit, node, nxt, 'switch-exit', NULL FROM full_ WHERE kind = 'switch'
 UNION ALL SELECT unit, node, coalesce(b, nxt), 'label-fallthrough', NULL FROM full_ WHERE kind = 'label'
 UNION ALL SELECT unit, node, -2, 'return', NULL FROM full_ WHERE kind = 'return'
 UNION ALL SELECT unit, node, brk, 'break', NULL FROM full_ WHERE kind = 'break'
 UNION ALL SELECT unit, node, cont, 'continue', NULL FROM full_ WHERE kind = 'continue'
 UNION ALL SELECT unit, node, l, CASE WHEN l IS NULL THEN 'goto' WHEN lpre > pre THEN 'goto-forward' ELSE 'goto-backward' END, NULL FROM full_ WHERE kind = 'goto'
 UNION ALL SELECT unit, node, nxt, 'fallthrough', NULL FROM full_ WHERE kind IN ('expr', 'case', 'default')
 UNION ALL SELECT unit, -1, node, 'entry', NULL FROM pre WHERE pre = 0)"""


@query(f"WITH RECURSIVE {_STATEMENTS_SQL}, {_TREE_SQL.format('st')}, {_EDGES_SQL} SELECT DISTINCT unit, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, kind, guard FROM edges")
def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cfg_edges(labelled(spark, sf_dir), "unit")


def _list_ends(rounds: int = 8) -> str:
    """SQL of the statement lists that always return; a round looks one if deeper."""
    out = "e0 AS (SELECT DISTINCT unit, parent, branch FROM st WHERE kind = 'return')"
    for k in range(1, rounds + 1):
        both = f"SELECT i.unit, i.parent, i.branch FROM st i WHERE i.kind = 'if' AND (SELECT count(*) FROM e{k - 1} e WHERE e.unit = i.unit AND e.parent = i.node) = 2"
        out += f", e{k} AS (SELECT * FROM e{k - 1} UNION {both})"
    return out + f", done AS (SELECT * FROM e{rounds})"


_NOT = "CASE WHEN {0} LIKE '!%' AND {0} NOT LIKE '!=%' THEN CASE WHEN trim({0}[2:]) LIKE '(%' AND trim({0}[2:]) LIKE '%)' THEN trim(trim({0}[2:])[2:-2]) ELSE trim({0}[2:]) END ELSE '!(' || {0} || ')' END"
#: Of the conditions in these tables those that only have x, y and constants.
_SAFE = "('x == 1', '!(y)', 'LIMIT < x', '!x', '', 'x != y', 'y', 'x')"


@query(f"""WITH RECURSIVE {_STATEMENTS_SQL}, {_TREE_SQL.format('st')}, {_FRAMES_SQL}, {_list_ends()},
single AS (SELECT unit, parent, min(node) AS child FROM st WHERE branch = 'else' GROUP BY ALL HAVING count(*) = 1 AND min(kind) = 'if'),
casc AS (SELECT unit, node AS root, node, 0 AS k FROM st WHERE kind = 'if' AND parent IS NULL UNION ALL SELECT c.unit, c.root, s.child, c.k + 1 FROM casc c JOIN single s ON s.unit = c.unit AND s.parent = c.node),
steps AS (SELECT c.*, s.text AS c, {_NOT.format('s.text')} AS n, EXISTS (SELECT 1 FROM done d WHERE d.unit = c.unit AND d.parent = c.node AND d.branch = 'then') AS t, EXISTS (SELECT 1 FROM done d WHERE d.unit = c.unit AND d.parent = c.node AND d.branch = 'else') AS e FROM casc c JOIN st s ON s.unit = c.unit AND s.node = c.node),
agg AS (SELECT unit, root, list(c ORDER BY k) AS cs, list(n ORDER BY k) AS ns, list(t ORDER BY k) AS ts, arg_max(e, k) AS e FROM steps GROUP BY ALL HAVING bool_and(c IN {_SAFE})),
br AS (SELECT unit, root, list_concat(list_transform(range(1, len(cs) + 1), lambda i: {{'g': array_to_string(list_transform(list_concat(ns[1:i - 1], [cs[i]]), lambda x: '(' || x || ')'), ' && '), 'x': ts[i]}}), [{{'g': array_to_string(list_transform(ns, lambda x: '(' || x || ')'), ' && '), 'x': e}}]) AS b FROM agg),
lefts AS (SELECT unit, root, list_filter(b, lambda x: NOT x.x) AS l FROM br WHERE len(list_filter(b, lambda x: x.x)) > 0),
sws AS (SELECT t.unit, t.node AS sw, t.text AS sel, n.node, n.kind, n.text, p.pre FROM st t JOIN up u ON u.unit = t.unit AND u.above = t.node AND u.node <> t.node JOIN st n ON n.unit = u.unit AND n.node = u.node JOIN pre p ON p.unit = n.unit AND p.node = n.node
  WHERE t.kind = 'switch' AND t.parent IS NULL AND t.text IN {_SAFE} AND n.kind IN ('case', 'default', 'return', 'goto')),
segs AS (SELECT l.unit, l.sw, l.sel, l.kind, l.text, l.pre, EXISTS (SELECT 1 FROM sws r WHERE r.unit = l.unit AND r.sw = l.sw AND r.kind IN ('return', 'goto') AND r.pre > l.pre AND NOT EXISTS (SELECT 1 FROM sws m WHERE m.unit = l.unit AND m.sw = l.sw AND m.kind IN ('case', 'default') AND m.pre > l.pre AND m.pre < r.pre)) AS x
  FROM sws l WHERE l.kind IN ('case', 'default')),
swg AS (SELECT unit, sw, CASE WHEN bool_or(kind = 'default' AND x) THEN string_agg('(' || sel || ' == ' || text || ')', ' || ' ORDER BY pre) FILTER (kind = 'case' AND NOT x) ELSE '!(' || string_agg('(' || sel || ' == ' || text || ')', ' || ' ORDER BY pre) FILTER (kind = 'case' AND x) || ')' END AS guard FROM segs GROUP BY ALL),
held AS (SELECT s.unit, s.node, s.text, p.pre, coalesce(array_to_string(list_transform(frames, lambda f: '(' || f.guard || ')'), ' && '), '1') AS g FROM st s JOIN pre p ON p.unit = s.unit AND p.node = s.node LEFT JOIN stacks k ON k.unit = s.unit AND k.node = s.node WHERE s.kind = 'goto')
SELECT l.unit, CAST(e.last AS BIGINT) AS "after", CAST(NULL AS BIGINT) AS "before", CASE WHEN len(l) = 0 THEN '0' ELSE array_to_string(list_transform(l, lambda x: '(' || x.g || ')'), ' || ') END AS guard, 'continuation' AS branch, 'early-exit' AS source FROM lefts l JOIN ends e ON e.unit = l.unit AND e.node = l.root
UNION ALL SELECT s.unit, e.last, NULL, '0', 'unreachable', 'early-exit' FROM st s JOIN ends e ON e.unit = s.unit AND e.node = s.node WHERE s.kind = 'return' AND s.parent IS NULL
UNION ALL SELECT s.unit, e.last, NULL, s.guard, 'continuation', 'switch-exit' FROM swg s JOIN ends e ON e.unit = s.unit AND e.node = s.sw WHERE s.guard IS NOT NULL
UNION ALL SELECT h.unit, h.pre, p.pre, {_NOT.format('h.g')}, 'fallthrough', 'forward-goto' FROM held h JOIN st l ON l.unit = h.unit AND l.kind = 'label' AND l.text = h.text JOIN pre p ON p.unit = l.unit AND p.node = l.node WHERE p.pre > h.pre""")
def continuation_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = labelled(spark, sf_dir)
    params = nodes.select("unit").distinct().withColumn("params", F.array(F.lit("x"), F.lit("y")))
    return X.continuation_guards(nodes, params, "unit")
