"""Data sets as folders of Parquet with versions: a small manifest names the folders whose rows are the data set, and no file is ever written over.

A manifest lists the folders of rows (`base`) and, for each column that was added or replaced later, the folders of its values (id, column), which reading joins to the
rows by id. A write puts its rows into new folders and then adds the next manifest; what it didn't finish is in no manifest. So a reader, who takes the last whole
manifest, sees a data set before or after a write, never between, and two writers at once both come through, one after the other.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Dataset:
    """Rows with an id, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """The numbers of all versions whose manifest is whole, in order."""
        return [n for n in self._numbers() if self._manifest(n) is not None]

    def _numbers(self) -> list[int]:
        folder = self._at("versions")
        if not self._files.exists(folder):
            return []
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in self._files.listStatus(folder) if x.getPath().getName().endswith(".json"))

    def _manifest(self, number: int) -> dict | None:
        """A version's manifest; none while it is being written, or if its writer was lost then."""
        stream = self._files.open(self._at(f"versions/{number:09d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _last(self) -> dict | None:
        for number in reversed(self._numbers()):
            if (found := self._manifest(number)) is not None:
                return found
        return None

    def _commit(self, change: Callable[[dict | None], dict]) -> None:
        """Adds the next manifest, changed from the last one; if another writer adds it first, from that one."""
        while True:
            numbers = self._numbers()
            text = json.dumps(change(self._last()))
            try:
                out = self._files.create(self._at(f"versions/{(numbers[-1] if numbers else 0) + 1:09d}.json"), False)
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                    continue
                raise
            out.write(text.encode())
            out.close()
            return

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*[f"{self.path}/{f}" for f in folders])

    def load(self, only: list[str] | None = None, ids: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The rows with all columns or the named ones, and of all ids or those listed; of the last version or another one."""
        manifest = self._last() if version is None else self._manifest(version)
        if manifest is None:
            raise FileNotFoundError(self.path)
        out = self._read(manifest["base"])
        if ids is not None:
            out = out.join(ids.select("id").distinct(), "id", "left_semi")
        for name, folders in manifest["columns"].items():
            if only is None or name in only:
                out = out.drop(name).join(self._read(folders), "id", "left")
        return out if only is None else out.select(*only)

    def ids(self) -> DataFrame:
        """The ids; no other column is read."""
        return self.load(only=["id"])

    def get(self, id) -> DataFrame:
        """The row of one id."""
        return self.load().filter(F.col("id") == F.lit(id))

    def save(self, rows: DataFrame, exist_ok: bool = False, append: bool = False) -> bool:
        """Writes the rows as a new data set, or appends them; no rows are not written, with a warning. Tells whether anything was written.

        A data set that is there already is an error, unless exist_ok, which replaces it with all its columns. Appended rows bring their own values of columns
        that were written later, null where they lack them.
        """
        if rows.isEmpty():
            warnings.warn(f"no rows to save at {self.path}", stacklevel=2)
            return False
        last = self._last()
        if last is not None and not (exist_ok or append):
            raise FileExistsError(f"{self.path} already exists")
        folder = self._write(rows)
        own = {n: self._write(rows.select("id", n)) for n in (last["columns"] if append and last else {}) if n in rows.columns}

        def change(now: dict | None) -> dict:
            if not append or now is None:
                return {"base": [folder], "columns": {}}
            for n in now["columns"]:
                if n in rows.columns and n not in own:  # another writer's, since
                    own[n] = self._write(rows.select("id", n))
            return {"base": [*now["base"], folder], "columns": {n: [*f, *([own[n]] if n in own else [])] for n, f in now["columns"].items()}}

        self._commit(change)
        return True

    def save_columns(self, rows: DataFrame, names: list[str]) -> None:
        """Writes the named columns of rows (with their id), in place of those that the data set has by these names; all of them come at once."""
        written = {n: [self._write(rows.select("id", n))] for n in names}

        def change(now: dict | None) -> dict:
            if now is None:
                raise FileNotFoundError(self.path)
            return {"base": now["base"], "columns": {**now["columns"], **written}}

        self._commit(change)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the last `keep`, and folders that no version left names. Not while others write or read older ones."""
        left = self.versions()[-keep:]
        manifests = [self._manifest(n) for n in left]
        named = {f for m in manifests for folders in (m["base"], *m["columns"].values()) for f in folders}
        for n in self._numbers():
            if n not in left:
                self._files.delete(self._at(f"versions/{n:09d}.json"), False)
        for x in self._files.listStatus(self._at("data")):
            if f"data/{x.getPath().getName()}" not in named:
                self._files.delete(x.getPath(), True)


def read_records(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Records of a file or folder: jsonl, json (one value over many lines), txt (one row for each line) or parquet."""
    if form == "jsonl":
        return spark.read.json(path)
    if form == "json":
        return spark.read.option("multiLine", True).json(path)
    if form == "txt":
        return spark.read.text(path)
    if form == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {form}")


def write_metrics(samples: DataFrame, summary: DataFrame, path: str, config: list[str]) -> None:
    """Writes each sample and the summary of runs, in folders by the columns that name a run; other runs' folders stay."""
    for rows, name in ((samples, "each-sample"), (summary, "summary")):
        rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(*config).mode("overwrite").parquet(f"{path}/{name}")


def tags(lines: DataFrame, field: str) -> DataFrame:
    """(tag): the values of a field, single or in lists, in the entries of records that are lines of JSON; trimmed, each once, sorted. Other lines are skipped."""
    record = F.from_json("value", "entries array<struct<values:map<string,string>>>")
    entry = lines.select(F.explode(record["entries"]).alias("e")).select(F.col("e.values")[field].alias("v"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>"))
    return entry.select(F.explode(F.coalesce(listed, F.array("v"))).alias("tag")).select(F.trim("tag").alias("tag")).filter("tag <> ''").distinct().orderBy("tag")


def macros(numbers: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """(line) for each (name, value, whole): a LaTeX macro with the number as tables print it."""
    text = F.when(F.col("whole"), F.format_number("value", 0)).otherwise(F.format_number("value", 2))
    return numbers.select(F.concat(F.lit(f"\\DefMacro{{{prefix}-"), "name", F.lit(f"-{suffix}}}{{"), text, F.lit("}")).alias("line"))


def without_throw(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by pos whose method has no throw: what a viewer shows."""
    return rows.filter(~F.contains("mut", F.lit("throw"))).orderBy("pos").limit(n)


def first_available(rows: DataFrame, share: Column, least: float = 0.79) -> DataFrame:
    """The first row by pos for which more than this share of its prompt's add-ons has something to say."""
    return rows.filter(share > least).orderBy("pos").limit(1)

