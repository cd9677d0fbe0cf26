"""Data sets with versions, and functions on what they once took for something else."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import code, prompts
from millrace.sources import datasets
from millrace.streaming.completion import completed_stream


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_data_set_versions(spark, tmp_path):
    data = datasets.Dataset(spark, str(tmp_path / "d"))
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v long")
    data.save(rows((1, 10), (2, 20)))
    data.save_columns(rows((1, -1), (2, -2)), ["v"])
    reader = data.load()
    data.save(rows((1, 100), (2, 200)), exist_ok=True)
    assert values(data.load()) == [(1, 100), (2, 200)]
    assert values(reader) == [(1, -1), (2, -2)]
    data.save_columns(rows((1, 7)).withColumn("w", F.lit("x")), ["w"])
    data.save(rows((3, 300)).withColumn("w", F.lit("y")), append=True)
    data.save(rows((4, 400)), append=True)
    assert values(data.load(["id", "v", "w"])) == [(1, 100, "x"), (2, 200, None), (3, 300, "y"), (4, 400, None)]
    assert data.versions() == [1, 2, 3, 4, 5, 6] and values(data.load(version=1)) == [(1, 10), (2, 20)]
    # A writer that was lost leaves half a manifest: nobody reads it, and the next write goes on after it.
    (tmp_path / "d" / "versions" / "000000007.json").write_text('{"base": [')
    assert len(values(data.load())) == 4
    data.save(rows((5, 500)), append=True)
    assert data.versions()[-1] == 8 and data.ids().count() == 5
    data.vacuum()
    assert data.versions() == [8] and data.ids().count() == 5 and values(data.load(["id", "w"]))[:2] == [(1, "x"), (2, None)]


def test_two_writers(spark, tmp_path):
    """A write that another one overtakes is put on top of it."""
    first, second = (datasets.Dataset(spark, str(tmp_path / "d")) for _ in range(2))
    first.save(spark.createDataFrame([(1, "a")], "id long, x string"))
    commit = first._commit

    def late(change):
        second.save(spark.createDataFrame([(2, "b")], "id long, x string"), append=True)
        commit(change)

    first._commit = late
    first.save(spark.createDataFrame([(3, "c")], "id long, x string"), append=True)
    assert sorted(r.id for r in second.ids().collect()) == [1, 2, 3]


def test_completed_stream_keeps_text_ids(spark, tmp_path):
    schema = "id string, idx int, results array<string>, expected int"
    spark.createDataFrame([("prefix-7", 1, ["b"], 2), ("prefix-7", 0, ["a"], 2), ("prefix-8", 0, ["x"], 2)], schema).write.parquet(str(tmp_path / "in"))
    stream = completed_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start().awaitTermination(90)
    assert [(r.id, r.results) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("prefix-7", ["a", "b"])]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("test", "want"),
    [
        ("void t() { // assertThrows is not used here\n a(); }", None),
        ('void t() { log("@Test(expected = X.class)"); /* expect(E.class) */ a(); }', None),
        ("@Test(timeout = 1, expected = a.b.X.class) void t() { a(); }", ("@Test(expected)", "a.b.X")),
        ("void t() { assertThrows(A.class, () -> f()); assertThrows( /* the last */ p.B.class, () -> g()); }", ("assertThrows", "p.B")),
        ("void t() { rule.expect(E.class); f(); }", ("expectedException.expect()", "E")),
        ("void t() { try { f(); fail(\"}\"); } catch (final E e) { } }", ("try{fail}catch", "E")),
    ],
)
def test_patterns_from_tokens(spark, test, want):
    got = one(spark, code.test_pattern(F.lit(test)))
    assert (tuple(got) if got else None) == want


def test_try_catch_with_annotations(spark):
    got = one(spark, code.with_try_catch(F.lit('@A(x = {1, 2}, y = "}{")\n@B public int m() { return 1; }')))
    assert got == '@A(x = {1, 2}, y = "}{")\n@B public int m() { try { return 1; } catch (Exception e) { return 0; } }'
    assert one(spark, code.with_try_catch(F.lit("abstract int m();"))) == "abstract int m();"
    with pytest.raises(Exception, match="not one method with a body"):
        one(spark, code.with_try_catch(F.lit("int x = 1; {")))


def test_headings_outside_of_fences(spark):
    text = "# a\n```sh\n# comment\n```\n## b\n~~~\n# c\n~~~\n# d\n```\n# open"
    assert one(spark, prompts.shifted(F.lit(text), 1)) == "## a\n```sh\n# comment\n```\n### b\n~~~\n# c\n~~~\n## d\n```\n# open"
