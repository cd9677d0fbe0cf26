"""Text functions as Column expressions: replies, keys, counts, comments, templates, log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fence of a reply's code, what stands for a reply without one, and the fields of coverage logs.
FENCE = r"```(\w*)\n([\s\S]*?)```"
NO_MATCH = "// No match"
LINE_NUMBER = r"LineNum:\[(\d+)\]"
EXCEPTION_TYPE = r"ExceptionType:\[(.*)\]"
EXCEPTION_FRAME = r"ExceptionST:\[(.*;.*;\d+)\]"

#: Between tokens: white space as Python's str.split() has it, not only ASCII.
UNICODE_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def extract_code(reply: Column, missing: str | None = NO_MATCH) -> Column:
    """The first fenced block of a reply; without one, `missing`: a comment that says so, an empty text or null."""
    return F.when(reply.rlike(FENCE), F.regexp_extract(reply, FENCE, 2)).otherwise(F.lit(missing))


def strip_thinking(reply: Column, end_token: Column) -> Column:
    """What follows the first end token, trimmed; the reply itself where there is no token or it doesn't occur."""
    at = F.instr(reply, end_token)
    after = F.trim(F.substring(reply, at + F.length(end_token), F.length(reply)))
    return F.when(end_token.isNotNull() & (end_token != "") & (at > 0), after).otherwise(reply)


def class_of(key: Column) -> Column:
    """pkg.Class of pkg.Class#method#descriptor."""
    return F.split_part(key, F.lit("#"), F.lit(1))


def method_of(key: Column) -> Column:
    return F.split_part(key, F.lit("#"), F.lit(2))


def outer_class_of(key: Column) -> Column:
    return F.split_part(class_of(key), F.lit("$"), F.lit(1))


def dotted(key: Column) -> Column:
    return F.translate(key, "/", ".")


def slashed(key: Column) -> Column:
    return F.translate(key, ".", "/")


def split_lines(text: Column) -> Column:
    """Number of parts between newlines: a newline at the end makes an empty last part."""
    return F.size(F.split(text, "\n", -1))


def counted_lines(text: Column) -> Column:
    """Number of lines: a newline at the end ends the last line."""
    return F.when(text == "", F.lit(0)).otherwise(split_lines(F.regexp_replace(text, r"\n\z", "")))


def token_count(text: Column) -> Column:
    """Number of tokens between white space of any kind."""
    return F.size(F.filter(F.split(text, UNICODE_SPACE), lambda x: x != ""))


def occurrences(text: Column, part: str) -> Column:
    """Occurrences of a plain string that don't overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def add_comment(code: Column, line: Column, text: Column) -> Column:
    """The code with a comment at the end of one line, numbered from 0."""
    lines = F.transform(F.split(code, "\n", -1), lambda x, i: F.when(i == line, F.concat(x, F.lit(" // "), text)).otherwise(x))
    return F.array_join(lines, "\n")


def remove_comment(code: Column, pattern: str) -> Column:
    """The code without comments (// and space) whose text matches the pattern; the space before them stays."""
    return F.regexp_replace(code, r"//\s*" + pattern, "")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A template whose placeholders ~`name`~ are filled; a name that it lacks or one left over is an error."""
    out = F.lit(template)
    for name, value in values.items():
        mark = f"~`{name}`~"
        if mark not in template:
            raise ValueError(f"the template has no placeholder {name}")
        out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
    left = template
    for name in values:
        left = left.replace(f"~`{name}`~", "")
    if "~`" in left:
        raise ValueError("a placeholder of the template is left")
    return out


def splice_lines(file: Column, start: Column, end: Column, code: Column) -> Column:
    """A file whose lines start to end, numbered from 1, are replaced by code."""
    lines = F.split(file, "\n", -1)
    rest = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), start - 1), F.array(code), rest), "\n")


def parameter_types(descriptor: Column) -> Column:
    """The class types that a descriptor names, slashed, in order, without those of java: (Lp/T;[ILjava/lang/String;)V gives p/T."""
    found = F.regexp_extract_all(descriptor, F.lit("L([0-9a-zA-Z/_]*);"), F.lit(1))
    return F.filter(found, lambda x: ~x.startswith("java/"))


def split_types(descriptor: Column) -> Column:
    """All types of a row of descriptors, arrays with their brackets: ILp/T;[[J gives I, Lp/T; and [[J."""
    return F.regexp_extract_all(descriptor, F.lit(r"\[*(?:L[^;]*;|[^\[L])"), F.lit(0))


#: The one-letter names of the simple types.
SIMPLE = {"int": "I", "long": "J", "float": "F", "double": "D", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "void": "V"}


def class_descriptor(name: Column) -> Column:
    """A type's name as a descriptor: int[] gives [I, p.T gives Lp/T;."""
    levels = F.length(F.regexp_extract(name, r"((?:\[\])*)$", 1)) / 2
    plain = F.regexp_replace(name, r"(\[\])+$", "")
    out = F.concat(F.lit("L"), F.translate(plain, ".", "/"), F.lit(";"))
    for word, letter in SIMPLE.items():
        out = F.when(plain == word, F.lit(letter)).otherwise(out)
    return F.concat(F.repeat(F.lit("["), levels.cast("int")), out)


def simple_type_name(descriptor: Column) -> Column:
    """A type's short name: [Lp/T; gives T[], I gives int; a dotted name its last part. V stays, it names no value."""
    levels = F.length(F.regexp_extract(descriptor, r"^(\[*)", 1))
    plain = F.regexp_replace(descriptor, r"^\[+", "")
    bare = F.when(plain.endswith(";"), F.substring(plain, F.lit(2), F.length(plain) - 2)).otherwise(plain)
    out = F.regexp_extract(bare, r"([^./]*)$", 1)
    for word, letter in SIMPLE.items():
        if letter != "V":
            out = F.when(plain == letter, F.lit(word)).otherwise(out)
    return F.concat(out, F.repeat(F.lit("[]"), levels))


def imports(source: Column) -> Column:
    """The names that a source file imports, in order, static ones with their word."""
    return F.regexp_extract_all(source, F.lit(r"(?m)^\s*import\s+((?:static\s+)?[\w.*]+)\s*;"), F.lit(1))


def qualified_class(source: Column, otherwise: Column) -> Column:
    """package.Class of a source file: its package, if it names one, and its public class, or another name if it has none."""
    package = F.regexp_extract(source, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    name = F.regexp_extract(source, r"public\s+class\s+(\w+)", 1)
    return F.concat(F.when(package != "", F.concat(package, F.lit("."))).otherwise(F.lit("")), F.when(name != "", name).otherwise(otherwise))


def subtokens(line: Column) -> Column:
    """Runs of ASCII letters and digits, and single other signs; what isn't ASCII is left out."""
    return F.regexp_extract_all(F.regexp_replace(line, r"[^\x00-\x7F]", ""), F.lit(r"[a-zA-Z0-9]+|[^\sa-zA-Z0-9]"), F.lit(0))


def dedent(text: Column) -> Column:
    """The text without the white space that all its lines begin with; lines of white space only become empty and don't count."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(r"^[ \t]*$"), F.lit("")).otherwise(x))
    margins = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.regexp_extract(x, r"^([ \t]*)", 1))
    # What the first and the last margin in order share, all between them share.
    a, b = F.array_min(margins), F.array_max(margins)
    same = F.filter(F.sequence(F.lit(0), F.length(a)), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    width = F.coalesce(F.array_max(same), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", x).otherwise(F.substring(x, width + 1, F.length(x)))), "\n")


def indent(text: Column, prefix: str) -> Column:
    """The text with a prefix before each line that isn't white space only."""
    return F.regexp_replace(text, r"(?m)^(?=[^\n]*\S)", prefix)


#: What a test file's frame holds in place of a test, and what its class's name begins with.
TEST_MARK = "/*TEST PLACEHOLDER*/"
ADHOC = "adhoc_"


def test_class(key: Column, method: Column) -> Column:
    """The name of the class that holds one test of pkg.Class: pkg.adhoc_Class and the test's name."""
    package = F.regexp_extract(key, r"^(.*\.)?[^.]*$", 1)
    return F.concat(package, F.lit(ADHOC), _last(key, "."), method)


def test_file(frame: Column, key: Column, method: Column, code: Column, mark: str = TEST_MARK) -> Column:
    """A frame with its mark replaced by a test, and its class renamed for that test."""
    filled = F.replace(frame, F.lit(mark), code)
    return F.replace(filled, F.concat(F.lit(ADHOC), _last(key, ".")), F.concat(F.lit(ADHOC), _last(key, "."), method))


def _last(name: Column, sign: str) -> Column:
    return F.substring_index(name, sign, -1)


def short_exception(name: Column) -> Column:
    """The part of a dotted name after its last dot and, there, its last dollar; a name without dots whole."""
    return F.when(name.contains("."), _last(_last(name, "."), "$")).otherwise(name)


def expect_exception(test: Column, exception: Column) -> Column:
    """The test whose annotations expect an exception; one that already has such an annotation stays as it is."""
    marked = F.concat(F.lit("@Test(expected = "), short_exception(exception), F.lit(".class)"))
    return F.when(test.contains("@Test(expected"), test).otherwise(F.replace(test, F.lit("@Test"), marked))


def number_text(value: Column, whole: bool) -> Column:
    """A number as tables print it: thousands apart, whole or with two decimals."""
    return F.format_number(value, 0 if whole else 2)


def throw_lines(code: Column, exception: Column, place: Column) -> Column:
    """Numbers of the lines, from 0, at which a method throws an exception.

    One line with `throw ` is the answer. Of several, those count that name the exception; if the first of them
    doesn't, the one at the exception's place among the method's exceptions goes first. A line that rethrows counts (again) for
    RuntimeException.
    """
    name = _last(_last(exception, "."), "$")
    lines = F.transform(F.split(F.regexp_replace(code, r"\n\z", ""), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    some = F.filter(lines, lambda s: s["x"].contains("throw "))

    def hits(s: Column) -> Column:
        again = F.when((name == "RuntimeException") & s["x"].contains("rethrow"), F.array(s["i"])).otherwise(F.array().cast("array<int>"))
        return F.concat(F.when(F.contains(s["x"], name), F.array(s["i"])).otherwise(F.array().cast("array<int>")), again)

    all_hits = F.flatten(F.transform(some, hits))
    by_place = F.when(F.size(hits(F.get(some, F.lit(0)))) == 0, F.array(F.get(some, place)["i"])).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(some) < 2, F.transform(some, lambda s: s["i"])).otherwise(F.concat(by_place, all_hits))


def log_entry(line: Column) -> Column:
    """(etest_method, exception, mut_key, stack_trace) of a tool's log line class#method#exception##frame##frame..., or null.

    The first part must have three fields and the first frame at least two.
    """
    parts = F.split(line, "##")
    head, frame = F.split(parts[0], "#"), F.trim(F.get(parts, F.lit(1)))
    good = (F.size(parts) > 1) & (F.size(head) == 3) & (F.size(F.split(frame, "#")) > 1)
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "\n")
    return F.when(good, F.struct(F.concat_ws("#", head[0], head[1]).alias("etest_method"), F.get(head, F.lit(2)).alias("exception"), frame.alias("mut_key"), rest.alias("stack_trace")))


def generic_parts(name: Column) -> Column:
    """A<B> as [A, B]; a plain name alone."""
    pattern = r"^([^<]*)<(.*)>$"
    return F.when(name.rlike(pattern), F.array(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))).otherwise(F.array(name))


def covered_lines(log: Column, start: Column, n_lines: Column) -> Column:
    """Lines of a method that a log covers, from 0, sorted: LineNum:[n] less the start line and 3, within the method."""
    found = F.transform(F.regexp_extract_all(log, F.lit(LINE_NUMBER), F.lit(1)), lambda x: x.cast("int") - start - 3)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 0) & (x < n_lines))))


def reported_exceptions(stdout: Column, start: Column) -> Column:
    """(line, exception) that the compiler reports as not declared, lines from the method's start, sorted."""
    pattern = r"\[(\d+),\d+\] unreported exception ([\w.]+);"
    lines = F.regexp_extract_all(stdout, F.lit(pattern), F.lit(1))
    names = F.regexp_extract_all(stdout, F.lit(pattern), F.lit(2))
    return F.array_sort(F.array_distinct(F.zip_with(lines, names, lambda a, b: F.struct((a.cast("int") - start - 2).alias("line"), b.alias("exc")))))


def is_one_throw(method: Column) -> Column:
    """Whether all that a method does is throw; a method without a body is an error."""
    body = r"\{([\s\S]*)\}"
    stripped = F.regexp_replace(F.regexp_extract(method, body, 1), r"^\s+", "")
    return F.when(method.rlike(body), stripped.startswith("throw")).otherwise(F.raise_error(F.lit("a method without a body")).cast("boolean"))


def slug(path: Column) -> Column:
    """A path as a flat key."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.jsonl$", ""), F.lit("/"), F.lit("__"))


def thrown_at(log: Column, key: Column, method: Column, start: Column) -> Column:
    """(line, exception) of the exception that a log of one test tells of, or null.

    Of the frames in the method's class, the first that is in the method gives its line, less the start line and 3; one in another method
    that the code names gives the first line of code with that name; whichever frame comes first counts. Lines must be above 0.
    """
    frames = F.transform(F.regexp_extract_all(log, F.lit(EXCEPTION_FRAME), F.lit(1)), lambda x: F.split(x, ";"))
    lines = F.split(F.regexp_replace(method, r"\n\z", ""), "\n", -1)

    def place(f: Column) -> Column:
        named = F.array_position(F.transform(lines, lambda x: F.contains(x, f[1])), F.lit(True)) - 1
        return F.when(f[1] == method_of(key), f[2].cast("long") - start - 3).otherwise(named)

    ours = F.filter(frames, lambda f: (f[0] == class_of(key)) & ((f[1] == method_of(key)) | F.contains(method, f[1])))
    at = F.get(F.transform(ours, place), F.lit(0))
    return F.when(log.rlike(EXCEPTION_TYPE) & (at > 0), F.struct(at.cast("int").alias("line"), F.regexp_extract(log, EXCEPTION_TYPE, 1).alias("exception")))


def matches(value: Column, pattern: str, group: int = 1) -> Column:
    """What a group of a pattern matches in a text, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(value, F.lit(pattern), F.lit(group))))
