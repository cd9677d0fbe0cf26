"""What the operators share: words, row keys and tables written to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: ASCII white space. A word is any run of other characters.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order, unchanged."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def let(value: Column, use) -> Column:
    """use(value) where the value is computed once for a row, however often the lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only where all tasks run on this machine may it be unset: a temporary one then serves."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


#: Bytes of an Arrow batch on its way to Python: what a task holds several times over.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches down to BATCH_BYTES in this session, unless its configuration names a size: rows of long texts would make large ones."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)


class Scratch:
    """Tables of one job in the shared folder, each written once as Parquet and read back.

    This cuts lineage: a lost executor costs the tasks that ran on it, not what came before. A table
    is dropped when later ones have been written from it; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        at, files = self._at(self.path)
        files.deleteOnExit(at)

    def _at(self, path: str):
        """The path and its file system, whichever store it is in."""
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(context._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        """The rows, written, with these options of the writer, and read back."""
        df.write.options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            at, files = self._at(f"{self.path}/{name}")
            files.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back; they stay until the application ends."""
    return Scratch(df.sparkSession, name).keep(df, "rows")


def same(left: Column, right: Column) -> Column:
    """Equality under which nulls are equal; still an equi-join key for Spark."""
    return left.eqNullSafe(right)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of those taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
