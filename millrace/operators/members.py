"""What a source file declares and throws, from its tree as a table of nodes (tree, node, parent, place, type, role, tok, start, end).

Roles are those a child has in its parent: name, type, modifier, thrown, body, expression. What encloses a node is looked up by intervals
(`intervals.innermost`), so no file is compared with itself. A type's or an exception's name is as the source writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import intervals
from millrace.operators.graph import stored

CALLABLES = ["MethodDeclaration", "ConstructorDeclaration"]
CLASS = "ClassOrInterfaceDeclaration"
#: Where a variable ends that is declared inside.
SCOPES = ["BlockStmt", "ForStmt", "ForEachStmt", "TryStmt", "CatchClause", "SwitchStmt", "LambdaExpr", *CALLABLES]
ACCESS = ["public", "private", "protected"]
KEY = ["tree", "node"]


def _of_type(*types: str) -> Column:
    return F.col("type").isin(*types)


def _spans(nodes: DataFrame, value: str = "around") -> DataFrame:
    return nodes.select("tree", "enter", "leave", F.col("node").alias(value))


def _children(nodes: DataFrame, role: str, value: str) -> DataFrame:
    """(tree, node, value) of the leaves of one role; the node is their parent."""
    return nodes.filter((F.col("role") == role) & F.col("tok").isNotNull()).select("tree", F.col("parent").alias("node"), F.col("tok").alias(value), "enter")


def _listed(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the values of each key in the order of the source."""
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("enter", value))).alias(name))
    return found.select(*keys, F.col(name)[value].alias(name))


def enclosing(nodes: DataFrame, points: DataFrame, around: DataFrame) -> DataFrame:
    """The points (tree, at, ...) with `around`, one row for each of the nodes in `around` that a point lies in; points in none are left out.

    The innermost is looked up, and then what is around that, in as many rounds as such nodes are nested.
    """
    spans = _spans(around)
    outer = stored(intervals.innermost(["tree"], around.select("tree", (F.col("enter") - 1).alias("at"), F.col("node").alias("inner")), spans, "around").filter("around IS NOT NULL").select("tree", "inner", F.col("around").alias("outer")))
    now = stored(intervals.innermost(["tree"], points, spans, "around").filter("around IS NOT NULL"))
    out = now
    while not outer.isEmpty() and not now.isEmpty():
        now = stored(now.withColumnRenamed("around", "inner").join(outer, ["tree", "inner"]).withColumn("around", F.col("outer")).select(*out.columns))
        out = out.unionByName(now)
    return out


def class_data(nodes: DataFrame) -> DataFrame:
    """(tree, class, kind, enter, text) of the members of every class of a numbered table: public_variables, private_methods and so on; all constructors are public_constructors.

    Members without an access word are left out. A method's text ends before its body; tokens have one space between them.
    """
    classes = _children(nodes.join(nodes.filter(_of_type(CLASS)).select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi"), "name", "class").select("tree", F.col("node").alias("parent"), "class")
    own = nodes.filter(_of_type("FieldDeclaration", *CALLABLES)).join(classes, ["tree", "parent"])
    access = _children(nodes, "modifier", "access").filter(F.col("access").isin(ACCESS)).groupBy(*KEY).agg(F.min_by("access", "enter").alias("access"))
    word = F.when(F.col("type") == "ConstructorDeclaration", F.lit("public_constructors")).otherwise(F.concat("access", F.when(F.col("type") == "FieldDeclaration", F.lit("_variables")).otherwise(F.lit("_methods"))))
    members = stored(own.join(access, KEY, "left").select(*KEY, "class", "enter", "leave", word.alias("kind")).filter("kind IS NOT NULL"))
    bodies = nodes.filter("role = 'body'").join(members.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    spans = _spans(members).unionByName(bodies.select("tree", "enter", "leave", F.lit(None).cast(nodes.schema["node"].dataType).alias("around")))
    leaves = intervals.innermost(["tree"], nodes.filter("tok IS NOT NULL").select("tree", F.col("enter").alias("at"), "enter", "tok"), spans, "around").filter("around IS NOT NULL")
    text = _listed(leaves, ["tree", "around"], "tok", "text").select("tree", F.col("around").alias("node"), F.array_join("text", " ").alias("text"))
    return members.join(text, KEY, "left").select("tree", "class", "kind", "enter", F.coalesce("text", F.lit("")).alias("text"))


def variables(nodes: DataFrame) -> DataFrame:
    """(tree, node, enter, name, kind, leave): every variable, parameter and field of a numbered table with its type and where it ends.

    A local variable or a parameter ends with the innermost block, loop, try, catch, switch, lambda or method around its declaration; a field holds for its whole class, so its `enter` is the class's.
    """
    declared = nodes.filter(_of_type("VariableDeclarator", "Parameter")).join(_children(nodes, "name", "name").drop("enter"), KEY)
    kinds = nodes.filter("role = 'type'").select("tree", F.col("parent").alias("node"), F.col("enter").alias("type_enter"), F.col("leave").alias("type_leave"))
    typed = kinds.select("tree", F.col("type_enter").alias("enter"), F.col("type_leave").alias("leave"), F.col("node").alias("around"))
    words = intervals.innermost(["tree"], nodes.filter("tok IS NOT NULL").select("tree", F.col("enter").alias("at"), "enter", "tok"), typed, "around").filter("around IS NOT NULL")
    kind = _listed(words, ["tree", "around"], "tok", "kind").select("tree", F.col("around").alias("node"), F.replace(F.array_join("kind", ""), F.lit(","), F.lit(", ")).alias("kind"))
    fields = nodes.filter(_of_type("FieldDeclaration")).select("tree", F.col("node").alias("parent"), F.lit(True).alias("field"))
    each = declared.join(kind, KEY, "left").join(fields, ["tree", "parent"], "left").select(*KEY, "enter", "name", "kind", F.coalesce("field", F.lit(False)).alias("field"), F.col("enter").alias("at"))
    scopes = nodes.filter(_of_type(*SCOPES)).select("tree", "enter", "leave", F.struct("enter", "leave").alias("scope"))
    classes = nodes.filter(_of_type(CLASS)).select("tree", "enter", "leave", F.struct("enter", "leave").alias("scope"))
    local = intervals.innermost(["tree"], each.filter("NOT field"), scopes, "scope").select(*KEY, "enter", "name", "kind", F.col("scope.leave").alias("leave"))
    field = intervals.innermost(["tree"], each.filter("field"), classes, "scope").select(*KEY, F.col("scope.enter").alias("enter"), "name", "kind", F.col("scope.leave").alias("leave"))
    return local.unionByName(field).filter("leave IS NOT NULL")


def local_types(nodes: DataFrame) -> DataFrame:
    """(tree, types): the types of all variables of a tree (parameters aside), in the order of their declarations."""
    declared = nodes.filter(_of_type("VariableDeclarator")).select(*KEY, F.col("enter").alias("place_of"))
    return _listed(variables(nodes).drop("enter").join(declared, KEY).withColumnRenamed("place_of", "enter"), ["tree"], "kind", "types")


def used_types(nodes: DataFrame) -> DataFrame:
    """(tree, node, name, kind): every name that is used, with the type of the variable that it means; null where none is in sight.

    The nearest earlier declaration whose scope has not ended counts: inner ones hide outer ones, and fields come last.
    """
    uses = nodes.filter("type = 'NameExpr' AND tok IS NOT NULL").select("tree", F.col("tok").alias("name"), "node", F.col("enter").alias("at"))
    return intervals.innermost(["tree", "name"], uses, variables(nodes), "kind").select(*KEY, "name", "kind")


def _throws(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent, enter, line, exception, created): every throw, and the name of the exception's class where it creates one, else its expression."""
    throws = nodes.filter(_of_type("ThrowStmt")).select(*KEY, "parent", "enter", F.col("start").alias("line"))
    thrown = nodes.filter("role = 'expression'").join(throws.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    created = thrown.filter(_of_type("ObjectCreationExpr")).select("tree", F.col("parent").alias("node"), F.col("node").alias("new"))
    name = created.join(_children(nodes, "type", "exception").select("tree", F.col("node").alias("new"), "exception"), ["tree", "new"]).select(*KEY, "exception", F.lit(True).alias("created"))
    words = intervals.innermost(["tree"], nodes.filter("tok IS NOT NULL").select("tree", F.col("enter").alias("at"), "enter", "tok"), thrown.select("tree", "enter", "leave", F.col("parent").alias("around")), "around").filter("around IS NOT NULL")
    text = _listed(words, ["tree", "around"], "tok", "words").select("tree", F.col("around").alias("node"), F.array_join("words", " ").alias("words"))
    return throws.join(name, KEY, "left").join(text, KEY, "left").select(*KEY, "parent", "enter", "line", F.coalesce("exception", "words", F.lit("")).alias("exception"), F.coalesce("created", F.lit(False)).alias("created"))


def _callables(nodes: DataFrame) -> DataFrame:
    """The methods and constructors that aren't abstract, with their names."""
    abstract = _children(nodes, "modifier", "word").filter("word = 'abstract'").select(*KEY)
    return nodes.filter(_of_type(*CALLABLES)).join(abstract, KEY, "left_anti").join(_children(nodes, "name", "name").drop("enter"), KEY)


def method_records(nodes: DataFrame) -> DataFrame:
    """(tree, node, class, name, tokens, exceptions, start_line, end_line, modifiers) of every method and constructor that isn't abstract; exceptions are `name@@line` of all throws inside, in order."""
    own = stored(_callables(nodes))
    leaves = nodes.filter("tok IS NOT NULL").select("tree", F.col("enter").alias("at"), "enter", "tok")
    throws = _throws(nodes).select("tree", F.col("enter").alias("at"), "enter", F.concat("exception", F.lit("@@"), F.col("line").cast("string")).alias("thrown"))
    tokens, thrown = (_listed(enclosing(nodes, p, own), ["tree", "around"], v, to).withColumnRenamed("around", "node") for p, v, to in ((leaves, "tok", "tokens"), (throws, "thrown", "exceptions")))
    words = _listed(_children(nodes, "modifier", "word"), KEY, "word", "modifiers")
    classes = nodes.filter(_of_type(CLASS)).join(_children(nodes, "name", "class").drop("enter"), KEY).select("tree", "enter", "leave", "class")
    placed = intervals.innermost(["tree"], own.select("tree", "node", "name", "start", "end", F.col("enter").alias("at")), classes, "class")
    none = F.array().cast("array<string>")
    out = placed.join(tokens, KEY, "left").join(thrown, KEY, "left").join(words, KEY, "left")
    return out.select(*KEY, "class", "name", *[F.coalesce(c, none).alias(c) for c in ("tokens", "exceptions")], F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.coalesce("modifiers", none).alias("modifiers"))


def throw_lines(nodes: DataFrame, header: int = 2) -> DataFrame:
    """(tree, node, exception, lines) of every method or constructor: -1 for an exception that it declares, then the lines of its throws, less those of the header that was put before the source."""
    own = stored(_callables(nodes))
    declared = _children(nodes, "thrown", "exception").join(own.select(*KEY), KEY, "left_semi").select(*KEY, "exception", F.lit(-1).cast("long").alias("line"), "enter")
    inside = enclosing(nodes, _throws(nodes).select("tree", F.col("enter").alias("at"), "enter", "exception", (F.col("line") - header).cast("long").alias("line")), own)
    rows = declared.unionByName(inside.select("tree", F.col("around").alias("node"), "exception", "line", "enter"))
    return _listed(rows, [*KEY, "exception"], "line", "lines")


def conditional_throws(nodes: DataFrame) -> DataFrame:
    """(tree, node, exception, nearest_if): for each method that declares exceptions, those of them that it creates and throws as a branch of an if or right in the block that is one; each once, with the first such if."""
    own = stored(_callables(nodes).filter("type = 'MethodDeclaration'"))
    declared = _children(nodes, "thrown", "exception").select(*KEY, "exception").distinct()
    declaring = own.join(declared.select(*KEY), KEY, "left_semi")
    throws = _throws(nodes).filter("created").select("tree", F.col("enter").alias("at"), "parent", "exception")
    parents = nodes.select("tree", F.col("node").alias("parent"), F.col("type").alias("parent_type"), F.col("parent").alias("above"))
    above = nodes.select("tree", F.col("node").alias("above"), F.col("type").alias("above_type"))
    branch = throws.join(parents, ["tree", "parent"]).join(above, ["tree", "above"], "left")
    branch = branch.filter("parent_type = 'IfStmt' OR parent_type = 'BlockStmt' AND above_type = 'IfStmt'").select("tree", "at", "exception")
    ifs = nodes.filter(_of_type("IfStmt")).select("tree", "enter", "leave", F.col("node").alias("nearest_if"))
    found = intervals.innermost(["tree"], intervals.innermost(["tree"], branch, ifs, "nearest_if"), _spans(declaring, "node"), "node").filter("node IS NOT NULL")
    return found.join(declared, [*KEY, "exception"], "left_semi").groupBy(*KEY, "exception").agg(F.min_by("nearest_if", "at").alias("nearest_if"))
