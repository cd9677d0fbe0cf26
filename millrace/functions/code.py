"""Java methods as tokens: signatures, complexity and bodies that only throw.

Tokens and all that follows from them are Columns; the complexity of nested code needs a scan, which is a small helper over batches of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Comments, text blocks, strings, characters, numbers, names, signs of several characters, single signs.
TOKEN = r"""//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[0-9][\w.]*|[\p{L}_$][\p{L}\p{N}_$]*|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|\S"""
CLOSED_BY = {"(": ")", "[": "]", "{": "}"}
TYPES = {"class", "interface", "enum", "record"}


def tokens(code: Column) -> Column:
    """The code's tokens in order, comments left out; what is inside a string is one token."""
    return F.filter(F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0)), lambda t: ~(t.startswith("//") | t.startswith("/*")))


def token_signature(code: Column) -> Column:
    """The tokens with one space between: equal for code that differs in comments and formatting only."""
    return F.array_join(tokens(code), " ")


def same_code(left: Column, right: Column) -> Column:
    return token_signature(left) == token_signature(right)


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """What `of` makes of a value, which is worked out once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _body(t: Column) -> Column:
    """The tokens between a method's first { and its last }; null without a body."""
    at = F.array_position(t, "{")
    return F.when((at > 0) & (F.element_at(t, -1) == "}"), F.slice(t, at.cast("int") + 1, F.greatest(F.size(t) - at.cast("int") - 1, F.lit(0))))


def has_empty_body(code: Column) -> Column:
    """Whether a method has a body without statements, comments aside."""
    return F.coalesce(_with(tokens(code), lambda t: F.size(_body(t)) == 0), F.lit(False))


def is_only_throw(code: Column) -> Column:
    """Whether a method's body is one throw statement: no ; ends a statement before the last token."""
    return F.coalesce(_with(tokens(code), lambda t: _with(_body(t), _throws_once)), F.lit(False))


def _throws_once(body: Column) -> Column:
    """Whether tokens begin with throw and their first ; outside of brackets is the last of them; brackets are counted in one pass."""
    step = lambda t: F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)
    end = lambda t, depth: F.when((t == ";") & (depth == 0), 1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))
    seen = F.aggregate(body, start, lambda acc, t: F.struct((acc["depth"] + step(t)).alias("depth"), (acc["ends"] + end(t, acc["depth"])).alias("ends")))
    once = _with(seen, lambda x: (x["ends"] == 1) & (x["depth"] == 0))
    return (F.get(body, F.lit(0)) == "throw") & (F.get(body, F.size(body) - 1) == ";") & once


def strip_lone_return_null(code: Column) -> Column:
    """A method whose body is `return null;` with an empty body, the statement's line gone if it stood alone on it; null for any other body.

    A comment that holds the same words loses them too. Only code with these words is looked at token by token.
    """
    words = code.rlike(r"return\s+null;")
    lone = F.when(words, _with(tokens(code), lambda t: F.array_join(_body(t), " ") == "return null ;"))
    alone = r"(?m)^[ \t]*return\s+null;[ \t]*(?:\n|\z)"
    return F.when(lone, F.when(code.rlike(alone), F.regexp_replace(code, alone, "")).otherwise(F.regexp_replace(code, r"return\s+null;", "")))


def decisions(found: list[str]) -> int | None:
    """The decision points of one method's tokens, those of lambdas and classes inside it left out; null if its brackets don't match.

    if, for, while (with a do before it or not), catch, ternary signs, case labels and && and ||, each one.
    """
    count, label, seen_body, arm = 0, False, False, False  # arm: the last arrow was that of a case
    opened: list[tuple[str, bool, bool]] = []  # what closes it, whether it is left out, whether it ends a `new` expression
    created = declared = False
    for i, t in enumerate(found):
        out = opened[-1][1] if opened else False
        before = found[i - 1] if i else ""
        after = found[i + 1] if i + 1 < len(found) else ""
        while opened and opened[-1][0] == "," and t in {",", ";", ")", "]", "}"}:  # a lambda without braces is over
            opened.pop()
            out = opened[-1][1] if opened else False
        if t in CLOSED_BY:
            lambda_body = t == "{" and before == "->" and not arm
            left_out = out or (t == "{" and (lambda_body or created or declared))
            seen_body = seen_body or t == "{"
            maker = t == "(" and _creates(found, i)
            opened.append((CLOSED_BY[t], left_out, maker))
            created = declared = False if t == "{" else declared
            continue
        if t in {")", "]", "}"}:
            if not opened or opened[-1][0] != t:
                return None
            created = opened.pop()[2] and after == "{"
            continue
        if t in TYPES and i and seen_body and before != ".":
            declared = True
        if t in {"case", "default"} and seen_body:
            label = True
            count += t == "case" and not out
        elif t == ":" or (t == "->" and label):
            label, arm = False, t == "->"
        elif t == "->":
            arm = False
            if after != "{":
                opened.append((",", True, False))
        elif not out:
            wildcard = t == "?" and before in {"<", ","} and after in {">", ",", "extends", "super"}
            count += t in {"if", "for", "while", "catch", "&&", "||"} or (t == "?" and not wildcard)
    return count if not opened and seen_body else None


def _creates(found: list[str], at: int) -> bool:
    """Whether the ( at this place follows `new` and a type's name."""
    i, depth = at - 1, 0
    while i >= 0 and (depth or found[i] in {".", ">", "<", ",", "?"} or found[i][0].isalpha() or found[i][0] in "_$"):
        depth += (found[i] == ">") - (found[i] == "<")
        if found[i] == "new":
            return True
        i -= 1
    return False


def cyclomatic_complexity(code: Column) -> Column:
    """1 and the decision points of a method; null if it isn't one method with a body."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or (n := decisions(list(x))) is None else 1 + n for x in batch], dtype="Int64")

    return F.pandas_udf(run, T.LongType())(tokens(code))


def test_pattern(test: Column) -> Column:
    """(pattern, exception) of a test: how it says that an exception is expected, the first of four ways that it uses, and which; null for a normal test.

    An annotation, assertThrows (of several the last one's exception, null if it names no class), a rule's expect(), or a try with a call of fail
    and a single catch. Exceptions are as the test writes them. What comments and strings say doesn't count.
    """
    plain = F.transform(tokens(test), lambda t: F.when(t.rlike("^[\"']"), "''").otherwise(t))
    return _with(plain, lambda parts: _with(F.array_join(parts, " "), lambda code: _pattern(parts, code)))


def _pattern(parts: Column, code: Column) -> Column:
    """test_pattern of a test's tokens without what strings say, and of these with one space between."""
    name = r"([\w$]+(?: \. [\w$]+)*)"
    expected = rf"@ Test \( (?:[^)]* )?expected = {name} \. class\b"
    thrown = F.regexp_extract_all(code, F.lit(rf"\bassertThrows \( {name} \. class\b"), F.lit(1))
    rule = rf"\bexpect \( {name} \. class \)"
    caught = rf"\btry \{{ .*?\bfail \(.*?\}} catch \( (?:final )?{name} \w+ \)"
    one = lambda p, e: F.struct(F.lit(p).alias("pattern"), F.replace(e, F.lit(" "), F.lit("")).alias("exception"))
    return (
        F.when(code.rlike(expected), one("@Test(expected)", F.regexp_extract(code, expected, 1)))
        .when(F.array_contains(parts, "assertThrows"), one("assertThrows", F.get(F.reverse(thrown), F.lit(0))))
        .when(code.rlike(rule), one("expectedException.expect()", F.regexp_extract(code, rule, 1)))
        .when(code.rlike(caught) & (F.size(F.filter(parts, lambda t: t == "catch")) == 1), one("try{fail}catch", F.regexp_extract(code, caught, 1)))
    )


#: What a method of a type gives back where there is nothing to give back; all others give null.
DEFAULTS = {"boolean": "false", "Boolean": "false", "char": "'\\0'", "Character": "'\\0'", **dict.fromkeys(("byte", "Byte", "short", "Short", "int", "Integer", "long", "Long"), "0"), "float": "0.0f", "Float": "0.0f", "double": "0.0", "Double": "0.0"}


def with_try_catch(method: Column) -> Column:
    """A method whose body is tried as a whole, and which gives back its type's default if it throws; one without a body stays as it is.

    Annotations before the method may have braces, brackets and strings of their own. Code with a brace that isn't one method with a body is an error, not left untried.
    """
    string, brackets = r"\"(?:\\.|[^\"\\])*\"", r"\([^()\"]*\)"
    annotations = rf"(?:\s*@[\w.$]+(?:\s*\((?:[^()\"]|{string}|{brackets})*\))?)*"
    parts = rf"(?s)^({annotations}[^{{]*?([\w.$<>,\[\]? ]*?)\s+\w+\s*\([^{{]*)\{{(.*)\}}\s*$"
    kind = F.regexp_replace(F.regexp_extract(method, parts, 2), r"^.*\s(?=\S+$)", "")
    value = F.lit("null")
    for name, default in DEFAULTS.items():
        value = F.when(kind == name, F.lit(default)).otherwise(value)
    back = F.when(kind == "void", F.lit("return;")).otherwise(F.concat(F.lit("return "), value, F.lit(";")))
    tried = F.concat(F.regexp_extract(method, parts, 1), F.lit("{ try {"), F.regexp_extract(method, parts, 3), F.lit("} catch (Exception e) { "), back, F.lit(" } }"))
    return F.when(method.rlike(parts), tried).when(method.contains("{"), F.raise_error(F.lit("not one method with a body")).cast("string")).otherwise(method)
