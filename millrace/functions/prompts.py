"""Markdown and prompts as Column expressions. A prompt's arguments are a dict of Columns; add-ons add to it, in the order of a registry.

The texts that introduce an add-on are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import add_comment, class_of, dedent, extract_code, fill_template, indent, method_of

#: Fixed value: what the name of an add-on that edits another argument begins with, editor@base:one,two.
EDITOR = "editor@"


def bullets(items: Column) -> Column:
    """An array as a Markdown list, one item a line."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")


def nested_bullets(groups: Column) -> Column:
    """Structs (name, items) as a list of lists."""
    return F.array_join(F.transform(groups, lambda g: F.concat(F.lit("- "), g["name"], F.lit("\n"), indent(bullets(g["items"]), "  "))), "")


def title(content: Column, level: int) -> Column:
    if level < 0:
        raise ValueError(f"no heading has the level {level}")
    return F.concat(F.lit("#" * level + " "), content)


def inline_code(code: Column) -> Column:
    return F.concat(F.lit("`"), code, F.lit("`"))


def code_block(code: Column, lang: str) -> Column:
    return F.concat(F.lit(f"```{lang}\n"), code, F.lit("\n```\n"))


def section(name: Column, level: int, body: Column, children: Column | None = None) -> Column:
    """A heading, its body and the texts of its subsections (an array); levels start at 1."""
    if level <= 0:
        raise ValueError(f"no section has the level {level}")
    below = F.array_join(children, "\n\n") if children is not None else F.lit("")
    return F.concat(title(name, level), F.lit("\n\n"), body, F.lit("\n\n"), below)


def shifted(markdown: Column, by: int) -> Column:
    """A Markdown text with all its headings demoted by so many levels, or promoted if negative; a heading can't rise above level 1.

    Lines between fences (three backquotes or tildes) are code and stay as they are, whatever they begin with; a fence that isn't closed goes on to the end.
    """
    level = lambda x: F.length(F.regexp_extract(x, r"^(#+) ", 1))
    line = lambda x: F.when(level(x) == 0, x).when(level(x) + by <= 0, F.raise_error(F.lit("a heading above level 1")).cast("string")).otherwise(F.concat(F.repeat(F.lit("#"), level(x) + by), F.substring(x, level(x) + 1, F.length(x))))
    # Every part but the first begins with a fence; every second one is code up to its closing fence.
    parts = F.split(markdown, r"(?m)(?=^ {0,3}(?:```|~~~))", -1)
    moved = F.transform(parts, lambda part, i: F.when(i % 2 == 1, part).otherwise(F.array_join(F.transform(F.split(part, "\n", -1), line), "\n")))
    return F.array_join(moved, "")


def base_arguments(key: Column, method: Column, tests: Column) -> dict[str, Column]:
    """The arguments that every prompt has; tests are structs (exception, raw_code) in order. Exceptions are named once each, sorted."""
    listed = F.transform(tests, lambda t, i: F.concat(F.lit("- EBT #"), i.cast("string"), F.lit("\n"), code_block(t["raw_code"], "java"), F.lit("\n\n")))
    return {
        "mut_name": method_of(key),
        "exceptions": F.array_join(F.array_sort(F.array_distinct(F.transform(tests, lambda t: t["exception"]))), ", "),
        "mut_no_throw": _strip(code_block(_strip(dedent(method)), "java")),
        "etests": F.array_join(listed, ""),
        "class_name": class_of(key),
    }


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def messages(system: str, user: str, arguments: dict[str, Column]) -> Column:
    """The chat (role, content) of a prompt: the system's text and the user's template, filled."""
    used = {k: v for k, v in arguments.items()}
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), fill_template(user, used).alias("content")))


def placeholders(template: str) -> list[str]:
    """The names of a template's placeholders, in order."""
    return re.findall(r"~`([^~]*)`~", template)


def one_field_messages(system: str, user: str) -> Column:
    """The chat of a template whose one placeholder is the name of a column."""
    names = placeholders(user)
    if not names:
        raise ValueError("the template has no placeholder")
    return messages(system, user, {names[0]: F.col(names[0])})


def class_info(description: str, key: Column, variables: Column, methods: Column) -> Column:
    """Variables, up to their last `=`, and methods of a class; empty without any. {} in the description is the class's name."""
    # A name without `=` loses its last sign, as the cut at the last one, where there is none, takes it off.
    names = F.transform(variables, lambda v: inline_code(F.when(v.contains("="), F.regexp_extract(v, r"(?s)^(.*)=", 1)).otherwise(F.substring(v, F.lit(1), F.length(v) - 1))))
    groups = F.filter(F.array(F.struct(F.lit("Variables").alias("name"), names.alias("items")), F.struct(F.lit("Methods").alias("name"), F.transform(methods, inline_code).alias("items"))), lambda g: F.size(g["items"]) > 0)
    text = F.concat(F.replace(F.lit(description), F.lit("{}"), class_of(key)), nested_bullets(groups), F.lit("\n"))
    return F.when(F.size(groups) > 0, text).otherwise(F.lit(""))


def types_info(description: str, types: Column, end: str = "") -> Column:
    """Types (name, methods) that have methods, each with their list: what parameters or local variables offer; empty without any."""
    some = F.filter(types, lambda t: F.size(t["methods"]) > 0)
    each = F.transform(some, lambda t: F.concat(F.lit("- "), t["name"], F.lit("\n"), indent(F.concat(F.lit("- Methods\n"), indent(bullets(F.transform(t["methods"], inline_code)), "  ")), "  ")))
    return F.when(F.size(some) > 0, F.concat(F.lit(description), F.array_join(each, ""), F.lit(end))).otherwise(F.lit(""))


def throw_info(description: str, exceptions: Column) -> Column:
    """Exceptions, a map of names to constructors; those without any are left out. Sorted by name."""
    entries = F.filter(F.array_sort(F.map_entries(exceptions)), lambda e: F.size(e["value"]) > 0)
    groups = F.transform(entries, lambda e: F.struct(inline_code(e["key"]).alias("name"), F.transform(e["value"], inline_code).alias("items")))
    return F.when(F.size(groups) > 0, F.concat(F.lit(description), nested_bullets(groups))).otherwise(F.lit(""))


def import_info(description: str, imports: Column) -> Column:
    return F.concat(F.lit(description + "\n"), bullets(F.transform(imports, inline_code)))


def normal_tests(description: str, tests: Column) -> Column:
    """The code of normal tests, numbered; empty without any."""
    each = F.transform(tests, lambda t, i: F.concat(F.lit("- NEBT #"), i.cast("string"), F.lit("\n"), code_block(t, "java"), F.lit("\n\n")))
    return F.when(F.size(tests) > 0, F.concat(F.lit(description), F.array_join(each, ""))).otherwise(F.lit(""))


def imported(exception: Column, imports: Column) -> Column:
    """Whether an import names the exception by its last part, the dot with it."""
    last = F.when(exception.contains("."), F.concat(F.lit("."), F.substring_index(exception, ".", -1))).otherwise(F.substring(exception, F.length(exception), F.lit(1)))
    return F.exists(imports, lambda i: F.contains(i, last))


def commented(block: Column, comments: Column, description: str) -> Column:
    """A fenced block of code with comments (line, text) added in order, and the description after it; without comments it stays as it is."""
    code = extract_code(block, None)
    edited = F.aggregate(comments, code, lambda acc, c: add_comment(acc, c["line"], c["text"]))
    return F.when(F.size(comments) > 0, F.concat(F.replace(block, code, edited), F.lit("\n" + description + "\n"))).otherwise(block)


def coverage_comments(coverage: Column) -> Column:
    """Comments that name the tests which cover a line; coverage has an array of lines for each test."""
    return F.flatten(F.transform(coverage, lambda lines, i: F.transform(lines, lambda n: F.struct(n.cast("int").alias("line"), F.concat(F.lit("EBT #"), i.cast("string")).alias("text")))))


def unreported_comments(unreported: Column, imports: Column) -> Column:
    """Comments on exceptions (line, exception) that the compiler wants caught, those of the line that comes first first."""
    order = F.array_distinct(F.transform(unreported, lambda u: u["line"]))
    by_line = F.flatten(F.transform(order, lambda n: F.filter(unreported, lambda u: u["line"] == n)))
    known = lambda u: F.concat(F.lit("unreported "), u["exception"], F.lit(" here, it needs to be catched"))
    return F.transform(by_line, lambda u: F.struct(u["line"].cast("int").alias("line"), F.when(imported(u["exception"], imports), known(u)).otherwise(F.lit("unreported exception here but class not imported, so catch it as `Exception`")).alias("text")))


def thrown_comments(thrown: Column, imports: Column, n_lines: Column) -> Column:
    """Comments on the lines at which tests saw an exception; thrown has a struct (line, exception) or null for each test."""

    def text(t: Column, i: Column) -> Column:
        at = F.concat(F.lit(" thrown here when running EBT #"), i.cast("string"))
        return F.when(imported(t["exception"], imports), F.concat(t["exception"], at)).otherwise(F.concat(F.lit("Exception"), at, F.lit(" you can handle it with `Exception`")))

    each = F.transform(thrown, lambda t, i: F.when(t.isNotNull(), F.struct(F.least(t["line"].cast("int"), n_lines - 2).alias("line"), text(t, i).alias("text"))))
    return F.filter(each, lambda c: c.isNotNull())


AddOn = Callable[[dict[str, Column]], Column]


def with_add_ons(template: str, arguments: dict[str, Column], appended: dict[str, AddOn], editors: dict[str, AddOn]) -> tuple[dict[str, Column], Column]:
    """(arguments with the add-ons that the template names, the share of these that had something to say).

    Add-ons that append come first, in the template's order, since those that edit (editor@base:one,two) may build on them; an
    editor takes the place of the argument that it edits. An appended one is there if its text isn't empty, an editor
    if each of its steps changes the text it began with. Without add-ons the share is null.
    """
    out, there = dict(arguments), []
    names = placeholders(template)
    for name in [n for n in names if not n.startswith(EDITOR)]:
        if name in appended:
            out[name] = appended[name](out)
            there.append(out[name] != "")
    for name in [n for n in names if n.startswith(EDITOR)]:
        base, steps = name[len(EDITOR) :].split(":")
        text = out.pop(base)
        changes = [editors[s]({**out, base: text}) != text for s in steps.split(",")]
        for step in steps.split(","):
            text = editors[step]({**out, base: text})
        out[name] = text
        there.append(_all(changes))
    share = sum((t.cast("double") for t in there), F.lit(0.0)) / len(there) if there else F.lit(None).cast("double")
    return out, share


def _all(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return out


def repair_errors(success: Column, stdout: Column, tests: Column, normal: Column, normal_code: Column) -> Column:
    """What went wrong with a sample: the build, failed exceptional tests (passed, stdout) and failed normal ones with their code; normal may be null."""
    built = F.when(~success, F.array(F.concat(F.lit("Compilation of maven module failed:\n"), stdout))).otherwise(F.array().cast("array<string>"))
    failed = F.filter(F.transform(tests, lambda t, i: F.when(~t["passed"], F.concat(F.lit("EBT #"), i.cast("string"), F.lit(" (shown above) failed:\n"), t["stdout"]))), lambda x: x.isNotNull())
    code = lambda i: F.get(normal_code, i)
    plain = F.filter(F.transform(normal, lambda t, i: F.when(~t["passed"] & (i < F.size(normal_code)), F.concat(F.lit("Non-EBT Test #"), i.cast("string"), F.lit(" failed:\nCode:\n"), code(i), F.lit("\n\nError:\n"), t["stdout"]))), lambda x: x.isNotNull())
    parts = F.concat(built, failed, F.coalesce(plain, F.array().cast("array<string>")))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(F.lit("No errors found"))
