"""Syntax trees over the driver's tables: brands as methods whose parts are statements of many kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import classes, conditions, graph, intervals, members, throw_removal
from millrace.queries import stored
from millrace.session import table

NODE = "node long, parent long, place int, type string, role string, tok string, start long, end long"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, n, p): each part of a brand, numbered from 1."""
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("tree"), number.alias("n"), F.col("p_partkey").alias("p"))


def _statement(base: Column, body: int, line: Column, parts: list[tuple]) -> Column:
    """Structs of NODE for a statement below `body`: parts are (number, parent's number or None, type, role, tok), in the order of their places."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    rows = []
    for place, (number, parent, kind, role, tok) in enumerate(parts):
        above = F.lit(body) if parent is None else base + parent
        at = line if parent is None else F.lit(place)
        rows.append(F.struct((base + number).cast("long"), above.cast("long"), at.cast("int"), F.lit(kind), text(role), text(tok), line.cast("long"), line.cast("long")))
    return F.array(*rows).cast(f"array<struct<{', '.join(x.replace(' ', ':') for x in NODE.split(', '))}>>")


def _trees(lines: DataFrame, fixed: list[tuple], kinds: Column) -> DataFrame:
    """Trees of the lines: fixed nodes (node, parent, place, type, role, tok, and a line if it isn't 0) of every brand, and each line's own."""
    shape = f"array<struct<{', '.join(x.replace(' ', ':') for x in NODE.split(', '))}>>"
    one = F.array(*[F.struct(*[F.lit(v) for v in (*row[:6], *(2 * row[6:] or (0, 0)))]) for row in fixed]).cast(shape)
    roots = lines.select("tree").distinct().select("tree", F.explode(one).alias("x"))
    return lines.select("tree", F.explode(kinds).alias("x")).unionByName(roots).select("tree", "x.*")


def _throwing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as methods: a part is an if that throws, one with an else, a try whose catch throws, a switch with an entry that does, or a throw."""
    lines, base, n = _lines(spark, sf_dir), F.col("n") * 100, F.col("n")
    a, b = F.concat(F.lit("a"), n.cast("string")), F.concat(F.lit("b"), n.cast("string"))
    t = lambda number, parent, tok: (number, parent, "Token", None, tok)
    plain = [(0, None, "IfStmt", None, None), t(1, 0, "if"), t(2, 0, "c"), (3, 0, "BlockStmt", None, None), t(4, 3, "{"), (5, 3, "ThrowStmt", None, None), t(6, 5, "throw"), t(7, 3, "}")]
    other = [*plain, t(8, 0, "else"), (9, 0, "BlockStmt", None, None), t(10, 9, "{"), (11, 9, "ExpressionStmt", None, None), t(12, 11, a), (13, 9, "ExpressionStmt", None, None), t(14, 13, b), t(15, 9, "}")]
    tried = [(0, None, "TryStmt", None, None), t(1, 0, "try"), (2, 0, "BlockStmt", None, None), t(3, 2, "{"), (4, 2, "ExpressionStmt", None, None), t(5, 4, a), t(6, 2, "}"), (7, 0, "CatchClause", None, None), (8, 7, "BlockStmt", None, None), t(9, 8, "{"), (10, 8, "ThrowStmt", None, None), t(11, 10, "throw"), t(12, 8, "}")]
    switch = [(0, None, "SwitchStmt", None, None), t(1, 0, "switch"), (2, 0, "SwitchEntry", None, None), t(3, 2, "case"), (4, 2, "ThrowStmt", None, None), t(5, 4, "throw"), (6, 0, "SwitchEntry", None, None), t(7, 6, "case"), (8, 6, "ExpressionStmt", None, None), t(9, 8, a), (10, 6, "BreakStmt", None, None), t(11, 10, "break")]
    bare = [(0, None, "ThrowStmt", None, None), t(1, 0, "throw")]
    made = [_statement(base, 2, n, x) for x in (plain, other, tried, switch, bare)]
    kinds = F.when(F.col("p") % 5 == 0, made[0]).when(F.col("p") % 5 == 1, made[1]).when(F.col("p") % 5 == 2, made[2]).when(F.col("p") % 5 == 3, made[3]).otherwise(made[4])
    return _trees(lines, [(1, None, 0, "MethodDeclaration", None, None), (2, 1, 0, "BlockStmt", None, None), (3, 2, 0, "Token", None, "{"), (4, 2, 10**9, "Token", None, "}")], kinds)


def throw_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every brand's method, and how many throws of each kind went."""
    left, markers = throw_removal.removed(_throwing(spark, sf_dir))
    names = {"n_if": throw_removal.IF, "n_catch": throw_removal.CATCH, "n_switch": throw_removal.SWITCH, "n_rest": throw_removal.REST}
    tally = markers.groupBy("tree").agg(*[F.count_if(F.col("marker") == m).alias(c) for c, m in names.items()])
    return intervals.texts(left).join(tally, "tree", "left").select("tree", "text", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def tree_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all suppliers in a walk of their tree."""
    return intervals.numbered(stored._nodes(spark, sf_dir)).select("node", "enter", "leave", "step", F.col("depth").cast("long").alias("depth"), "leaves")


def _declaring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as classes with a field v0 and a method that declares E0 and E1: a part declares a variable, uses one, throws, or throws under a condition."""
    lines, base, n, p = _lines(spark, sf_dir), F.col("n") * 100, F.col("n"), F.col("p")
    name, kind, thrown = F.concat(F.lit("v"), (p % 2).cast("string")), F.concat(F.lit("T"), (p % 7).cast("string")), F.concat(F.lit("E"), (p % 3).cast("string"))
    t = lambda number, parent, role, tok: (number, parent, "Token", role, tok)
    declared = [(0, None, "ExpressionStmt", None, None), (1, 0, "VariableDeclarationExpr", "expression", None), (2, 1, "VariableDeclarator", None, None), (3, 2, "ClassOrInterfaceType", "type", None), t(4, 3, "name", kind), t(5, 2, "name", name)]
    used = [(0, None, "ExpressionStmt", None, None), (1, 0, "NameExpr", "expression", name)]
    new = lambda at, parent: [(at, parent, "ThrowStmt", None, None), t(at + 1, at, None, "throw"), (at + 2, at, "ObjectCreationExpr", "expression", None), t(at + 3, at + 2, "type", thrown)]
    guarded = [(0, None, "IfStmt", None, None), (1, 0, "NameExpr", "condition", name), (2, 0, "BlockStmt", "then", None), *new(3, 2)]
    made = [_statement(base, 10, n, x) for x in (declared, used, new(0, None), guarded)]
    kinds = F.when(p % 4 == 0, made[0]).when(p % 4 == 1, made[1]).when(p % 4 == 2, made[2]).otherwise(made[3])
    fixed = [
        (1, None, 0, "ClassOrInterfaceDeclaration", None, None), (2, 1, 0, "Token", "name", "C"), (3, 1, 1, "FieldDeclaration", None, None), (4, 3, 0, "Modifier", "modifier", "private"),
        (5, 3, 1, "VariableDeclarator", None, None), (6, 5, 0, "PrimitiveType", "type", "int"), (7, 5, 1, "Token", "name", "v0"), (8, 1, 2, "MethodDeclaration", None, None),
        (9, 8, 0, "Token", "name", "m"), (10, 8, 9, "BlockStmt", "body", None), (11, 8, 1, "Modifier", "modifier", "public"), (12, 8, 2, "Token", "thrown", "E0"), (13, 8, 3, "Token", "thrown", "E1"),
    ]
    return _trees(lines, fixed, kinds)


def used_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of all names that parts use: the last part's that declares the name before, else the field's."""
    return members.used_types(graph.stored(intervals.numbered(_declaring(spark, sf_dir)))).select("tree", F.floor(F.col("node") / 100).alias("n"), "name", "kind")


def conditional_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared exceptions that brands' methods throw under a condition, with the first such part."""
    return members.conditional_throws(graph.stored(intervals.numbered(_declaring(spark, sf_dir)))).select("tree", "exception", F.floor(F.col("nearest_if") / 100).alias("n"))


def method_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's method with its exceptions by line, the lines of each, and the members of its class."""
    nodes = graph.stored(intervals.numbered(_declaring(spark, sf_dir)))
    records = members.method_records(nodes).select("tree", "class", "name", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("exceptions", ",").alias("exceptions"), F.array_join("modifiers", " ").alias("modifiers"))
    lines = members.throw_lines(nodes, 0).groupBy("tree").agg(F.array_join(F.array_sort(F.collect_list(F.concat("exception", F.lit(":"), F.array_join(F.col("lines").cast("array<string>"), " ")))), ",").alias("lines"))
    data = members.class_data(nodes).groupBy("tree").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), "text"))), ",").alias("members"))
    types = members.local_types(nodes).select("tree", F.array_join("types", " ").alias("types"))
    return records.join(lines, "tree").join(data, "tree").join(types, "tree")


def path_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as methods that end with a call, whose parts leave early or assign: what holds where the call is reached."""
    lines, base, n = _lines(spark, sf_dir), F.col("n") * 100, F.col("n")
    name = F.concat(F.lit("x"), F.floor(F.col("p") / 2 % 2).cast("string"))
    guard = [(0, None, "IfStmt", None, None), (1, 0, "BinaryExpr", "condition", None), (2, 1, "NameExpr", None, name), (3, 1, "Token", None, "<"), (4, 1, "Token", None, n.cast("string")), (5, 0, "ReturnStmt", "then", None), (6, 5, "Token", None, "return")]
    given = [(0, None, "ExpressionStmt", None, None), (1, 0, "AssignExpr", "expression", None), (2, 1, "NameExpr", "target", name), (3, 1, "NameExpr", "value", F.concat(F.lit("y"), n.cast("string")))]
    kinds = F.when(F.col("p") % 2 == 0, _statement(base, 3, n, guard)).otherwise(_statement(base, 3, n, given))
    fixed = [(1, None, 0, "MethodDeclaration", None, None), (2, 1, 0, "Token", "name", "m"), (3, 1, 1, "BlockStmt", "body", None), (4, 3, 10**9, "ExpressionStmt", None, None, 10**9), (5, 4, 0, "MethodCallExpr", "expression", None, 10**9), (6, 5, 0, "Token", "name", "end", 10**9)]
    nodes = graph.stored(intervals.numbered(_trees(lines, fixed, kinds)))
    frames = lines.select(F.col("tree").alias("trace"), F.lit(0).alias("pos"), "tree", F.lit(10**9).cast("long").alias("line")).distinct()
    return conditions.path_conditions(nodes, frames)


def resolved_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as uses of types in orders as files; parts and suppliers as classes, customers' orders import one and two packages."""
    t = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), t("p", F.col("l_orderkey") % 5).alias("package"), t("T", F.col("l_partkey") % 50).alias("name"))
    orders = table(spark, sf_dir, "orders")
    single = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file"), t("q.T", F.col("o_custkey") % 50).alias("path"), F.lit(False).alias("wildcard"))
    some = [orders.select(F.col("o_orderkey").alias("file"), t("p", F.col(c) % 7).alias("path"), F.lit(True).alias("wildcard")) for c in ("o_orderkey", "o_custkey")]
    p = F.col("p_partkey")
    known = table(spark, sf_dir, "part").select(F.concat(t("p", p % 7), t(".T", F.floor(p / 7) % 23)).alias("full"))
    lang = table(spark, sf_dir, "supplier").select(t("java.lang.T", F.col("s_suppkey") % 40).alias("full"))
    out = classes.resolved_types(uses, single.unionByName(some[0]).unionByName(some[1]), known.unionByName(lang))
    return out.select("file", "name", "full", "rank", F.array_join("ambiguous", ",").alias("ambiguous"))


def class_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as classes whose parent has half their number, parts as methods of them: all relations between their ids."""
    s = F.col("s_suppkey")
    parents = table(spark, sf_dir, "supplier").select(s.alias("node"), F.when(s > 1, F.floor(s / 2)).alias("parent"))
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("class")).select(F.col("l_partkey").alias("id"), "class")
    return classes.class_relations(parents, first)[1].select("src", "dst", "label", F.col("steps").cast("long").alias("steps"))


QUERIES = {f.__name__: f for f in (resolved_types, class_relations, path_conditions, throw_removals, tree_intervals, used_types, conditional_throws, method_records)}
_L = "l AS (SELECT p_brand AS tree, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_partkey AS p FROM part)"
ORACLES = {
    "resolved_types": "WITH u AS (SELECT DISTINCT l_orderkey AS file, 'p' || (l_orderkey % 5) AS package, 'T' || (l_partkey % 50) AS name FROM lineitem), c AS (SELECT DISTINCT 'p' || (p_partkey % 7) || '.T' || (p_partkey // 7 % 23) AS f FROM part UNION SELECT 'java.lang.T' || (s_suppkey % 40) FROM supplier), g AS (SELECT u.*, 1 AS rank, 'q.' || name AS f FROM u JOIN orders ON o_orderkey = file WHERE o_orderkey % 3 = 0 AND name = 'T' || (o_custkey % 50) UNION SELECT * FROM (SELECT u.*, 2, package || '.' || name AS f FROM u UNION SELECT u.*, 3, unnest(['p' || (o_orderkey % 7), 'p' || (o_custkey % 7)]) || '.' || name FROM u JOIN orders ON o_orderkey = file UNION SELECT u.*, 4, 'java.lang.' || name FROM u) WHERE f IN (SELECT f FROM c)), r AS (SELECT file, name, rank, list_sort(list_distinct(list(f))) AS fs FROM g GROUP BY 1, 2, 3), b AS (SELECT file, name, arg_min({'rank': rank, 'fs': fs}, rank) AS b FROM r GROUP BY 1, 2) SELECT u.file, u.name, CASE WHEN len(b.fs) = 1 THEN b.fs[1] END AS full, b.rank AS rank, CASE WHEN len(b.fs) > 1 THEN array_to_string(b.fs, ',') END AS ambiguous FROM u LEFT JOIN b USING (file, name)",
    "class_relations": "WITH RECURSIVE c AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS id FROM (SELECT s_suppkey FROM supplier UNION SELECT s_suppkey // 2 FROM supplier WHERE s_suppkey > 1)), m AS (SELECT l_partkey AS k, min(l_suppkey) AS class, row_number() OVER (ORDER BY l_partkey) - 1 + (SELECT count(*) FROM c) AS id FROM lineitem GROUP BY 1), a AS (SELECT s_suppkey AS node, s_suppkey // 2 AS x, 1 AS d FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT node, x // 2, d + 1 FROM a WHERE x > 1) SELECT c.id AS src, e.id AS dst, CASE WHEN d = 1 THEN 'E' ELSE 'A' END AS label, d::BIGINT AS steps FROM a JOIN c ON c.k = node JOIN c e ON e.k = x UNION ALL SELECT c.id, m.id, 'M', 1 FROM m JOIN c ON c.k = m.class",
    "path_conditions": f"WITH {_L}, g AS (SELECT tree, n, 'x' || (p // 2 % 2) AS x FROM l WHERE p % 2 = 0), s AS (SELECT tree, n, 'x' || (p // 2 % 2) AS x FROM l WHERE p % 2 = 1), c AS (SELECT tree, n, '!' || coalesce('y' || (SELECT max(s.n) FROM s WHERE s.tree = g.tree AND s.x = g.x AND s.n < g.n), x) || ' < ' || n AS c FROM g) SELECT tree AS trace, concat_ws(' && ', (SELECT string_agg(c, ' && ' ORDER BY n) FROM c WHERE c.tree = o.tree), 'end') AS condition FROM (SELECT DISTINCT tree FROM l) o",
    "throw_removals": f"WITH {_L} SELECT tree, concat_ws(' ', '{{', string_agg(CASE p % 5 WHEN 1 THEN 'a' || n || ' b' || n WHEN 2 THEN 'a' || n WHEN 3 THEN 'a' || n END, ' ' ORDER BY n), '}}') AS text, count(*) FILTER (p % 5 < 2) AS n_if, count(*) FILTER (p % 5 = 2) AS n_catch, count(*) FILTER (p % 5 = 3) AS n_switch, count(*) FILTER (p % 5 = 4) AS n_rest FROM l GROUP BY tree",
    "tree_intervals": "WITH RECURSIVE m AS (SELECT max(s_suppkey) AS most FROM supplier), w AS (SELECT 1::BIGINT AS node, 0 AS depth, [0]::BIGINT[] AS path UNION ALL SELECT s_suppkey, depth + 1, list_append(path, s_suppkey) FROM w JOIN supplier ON s_suppkey // 2 = w.node WHERE s_suppkey > 1), a AS (SELECT node, unnest(path) AS above FROM w), z AS (SELECT CASE above WHEN 0 THEN 1 ELSE above END AS node, count(DISTINCT a.node) AS size, count(DISTINCT a.node) FILTER (a.node * 2 > most) AS leaves FROM a, m GROUP BY 1), o AS (SELECT w.node, depth, size, leaves, row_number() OVER (ORDER BY path) - 1 AS step FROM w JOIN z USING (node)) SELECT node, 2 * step - depth AS enter, 2 * step - depth + 2 * size - 1 AS leave, step, depth::BIGINT AS depth, leaves FROM o",
    "used_types": f"WITH {_L}, u AS (SELECT * FROM l WHERE p % 4 IN (1, 3)), d AS (SELECT * FROM l WHERE p % 4 = 0) SELECT u.tree, u.n::BIGINT AS n, 'v' || (u.p % 2) AS name, coalesce((SELECT arg_max('T' || (d.p % 7), d.n) FROM d WHERE d.tree = u.tree AND d.n < u.n AND d.p % 2 = u.p % 2), CASE WHEN u.p % 2 = 0 THEN 'int' END) AS kind FROM u",
    "conditional_throws": f"WITH {_L} SELECT tree, 'E' || (p % 3) AS exception, min(n)::BIGINT AS n FROM l WHERE p % 4 = 3 AND p % 3 < 2 GROUP BY 1, 2",
    "method_records": f"WITH {_L}, t AS (SELECT * FROM l WHERE p % 4 > 1), x AS (SELECT tree, e, string_agg(n, ' ' ORDER BY n) AS lines FROM (SELECT tree, 'E' || (p % 3) AS e, n FROM t UNION ALL SELECT DISTINCT tree, unnest(['E0', 'E1']), -1 FROM l) GROUP BY 1, 2), y AS (SELECT tree, string_agg(e || ':' || lines, ',' ORDER BY e) AS lines FROM x GROUP BY 1) SELECT l.tree, 'C' AS class, 'm' AS name, 4 + sum(CASE p % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END)::BIGINT AS n_tokens, coalesce(string_agg(CASE WHEN p % 4 > 1 THEN 'E' || (p % 3) || '@@' || n END, ',' ORDER BY n), '') AS exceptions, 'public' AS modifiers, any_value(y.lines) AS lines, 'private_variables=private int v0,public_methods=m public E0 E1' AS members, concat_ws(' ', 'int', string_agg(CASE WHEN p % 4 = 0 THEN 'T' || (p % 7) END, ' ' ORDER BY n)) AS types FROM l JOIN y USING (tree) GROUP BY l.tree",
}
