"""Column files, repair rounds and the stream of completed tasks on small inputs."""

import json

import pytest

from millrace.operators.repair import next_round, open_samples
from millrace.sources.column_files import read_column_files
from millrace.streaming import completion
from millrace.streaming.completion import completed_stream


def _write(folder, **fields):
    for name, values in fields.items():
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(v) + "\n" for v in values))


def test_column_files_keep_line_order_over_many_blocks(spark, tmp_path):
    _write(tmp_path, id=list(range(3000)), tags=[[f"t{i}"] * (i % 3) for i in range(3000)], note=[None if i % 7 == 0 else "é" * (i % 50) for i in range(3000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_column_files(spark, str(tmp_path), {"id": "long", "tags": "array<string>", "note": "string"}).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.pos, r.id, r.tags, r.note) for r in rows] == [(i, i, [f"t{i}"] * (i % 3), None if i % 7 == 0 else "é" * (i % 50)) for i in range(3000)]


def test_column_files_subset_empty_and_unequal(spark, tmp_path):
    _write(tmp_path, id=[5, 6, 5], x=[1.5, 2, None], short=[1], none=[])
    ids = spark.createDataFrame([(5,), (5,), (9,)], "id long")
    got = read_column_files(spark, str(tmp_path), {"id": "long", "x": "double"}, ids)
    assert sorted((r.pos, r.x) for r in got.collect()) == [(0, 1.5), (2, None)]
    assert read_column_files(spark, str(tmp_path), {"none": "long"}).collect() == []
    with pytest.raises(Exception, match="short.jsonl has no line"):
        read_column_files(spark, str(tmp_path), {"id": "long", "short": "long"}).collect()


def test_repair_round(spark):
    schema = "id long, sample long, output string, passed boolean, extra string"
    old = spark.createDataFrame([(1, 0, "a", True, "e"), (1, 1, "b", False, None), (2, 0, None, None, None), (None, 0, "n", False, None)], schema)
    new = spark.createDataFrame([(1, 0, "A", False, "e"), (1, 1, "B", True, None), (9, 0, "z", True, None), (None, 0, "N", True, None)], schema)
    got = {(r.id, r.sample): (r.output, r.passed, r.carried) for r in next_round(old, new).collect()}
    assert got == {(1, 0): ("a", True, True), (1, 1): ("B", True, False), (2, 0): (None, False, False), (None, 0): ("n", False, False)}
    assert open_samples(old).count() == 3
    assert next_round(old.limit(0), new).collect() == []


def test_completed_stream(spark, tmp_path):
    schema = "id long, idx int, results array<string>, expected int"
    source = tmp_path / "in"
    steps = [[(1, 1, ["b"], 2), (2, 0, ["x"], 1), (3, 0, ["never"], 2), (None, 0, ["n"], 1)], [(1, 1, ["again"], 2), (1, 0, ["a", "a2"], 2)]]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = completed_stream(spark.readStream.schema(schema).parquet(str(source)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination(90)
    assert sorted((r.id, r.results) for r in spark.read.parquet(out).collect()) == [(1, ["a", "a2", "b"]), (2, ["x"])]


@pytest.mark.parametrize("kind", ["string", "long"])
def test_stream_holds_open_tasks_only(spark, tmp_path, monkeypatch, kind):
    """Tasks that a batch brings whole write no state; open ones of the same bucket, which are numbers here, stay open when others end."""
    if kind == "long":
        monkeypatch.setattr(completion, "BUCKETS", 1)
    name = lambda i: f"t{i}" if kind == "string" else i
    schema = f"id {kind}, idx int, results array<string>, expected int"
    out, mark, source = str(tmp_path / "out"), str(tmp_path / "mark"), str(tmp_path / "in")
    steps = [[(name(i), k, [f"{i}:{k}"], 2) for i in range(300) for k in (1, 0)], [(name(i), 0, [f"{i}:0"], 3) for i in range(1000, 1100)], [(name(i), k, [f"{i}:{k}"], 3) for i in range(1000, 1050) for k in (2, 1, 0)], [(name(1099), 0, ["late"], 3)]]
    rows = []
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(source)
        query = completed_stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(90)
        rows.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
    assert rows[0] == 0 and rows[1] > 0
    got = {r.id: r.results for r in spark.read.schema(f"id {kind}, results array<string>").parquet(out).collect()}
    assert got == {name(i): [f"{i}:0", f"{i}:1"] for i in range(300)} | {name(i): [f"{i}:0", f"{i}:1", f"{i}:2"] for i in range(1000, 1050)}
