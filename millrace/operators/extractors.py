"""A registry of extractors: each adds one field to the method table, from what is there and what earlier ones added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text

#: The fields in the order in which they are extracted; each is a Column over the method table.
EXTRACTORS: dict[str, Callable[[], Column]] = {
    "fqcn": lambda: text.qualified_class(F.col("source"), text.class_of(F.col("mut_key"))),
    "import_info": lambda: text.imports(F.col("source")),
    "parameter_types": lambda: text.parameter_types(F.element_at(F.split("mut_key", "#"), -1)),
    "coverage": lambda: F.transform("logs", lambda log: text.covered_lines(log, F.col("start_line"), text.split_lines(F.col("mut")))),
    "unreported_exception": lambda: text.reported_exceptions(F.col("stdout"), F.col("start_line")),
    "thrown_exception": lambda: F.transform("logs", lambda log: text.thrown_at(log, F.col("mut_key"), F.col("mut"), F.col("start_line"))),
    "covered_count": lambda: F.size(F.array_distinct(F.flatten("coverage"))),
}


def extracted(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows with the named fields, in the order of the registry, whatever the order of the names; a field that is there is replaced. Unknown names are an error."""
    if unknown := set(names) - set(EXTRACTORS):
        raise ValueError(f"no extractor {sorted(unknown)}")
    for name, field in EXTRACTORS.items():
        if name in names:
            rows = rows.withColumn(name, field())
    return rows
