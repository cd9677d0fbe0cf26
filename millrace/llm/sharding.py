"""Operator 2, sharding: a tree of regions, racks and shards, descended by weighted hash draws.

At each level every child draws -ln(u) / weight from a hash of its own path and the row's key, and the
smallest draw wins, so a child is chosen in proportion to its weight. Draws of one child do not depend
on its siblings: where a subtree's weight grows, rows move only into it; where it shrinks, only out of
it; all other rows stay. A shard that is added as a region of its own therefore takes rows only into
itself, which is the law `key`: the key and the tree decide.

Slots number each shard's rows from 0 without a gap. A row's place is its hash; equal rows are counted as one, the rows of
one shard are cut into buckets by their place, each bucket is numbered by itself, and the small table of bucket
counts gives each bucket's first slot. Rows that repeat come back as runs of slots, cut into pieces. No task
ever holds a whole shard or all rows that are equal.

Defined results. A null key draws as the text "null"; a null text has size 1 and the CRC of nothing, 0.
Rows that repeat land in the same shard, each with a slot of its own. An empty table gives no rows.
Columns of the input that are not named are kept as they are and may have any names; maps can't be numbered, as they can't be compared.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh, text_of, written
from millrace.session import table

#: A tree: weights of shards, by rack, by region.
Tree = list[list[list[float]]]
_UNIT = 2.0**52


def even_tree(regions: int, racks: int, shards: int, weight: float = 1.0) -> Tree:
    """A tree of equal shards."""
    return [[[weight] * shards for _ in range(racks)] for _ in range(regions)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own, so that rows move only into it."""
    return [*tree, [[weight]]]


def _draw(key: Column, path: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(path, F.lit("|"), key)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(_UNIT)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _chosen(key: Column, prefix: Column, weights: Column) -> Column:
    """The index of the child whose draw is least; weights is an array with one entry for each child."""
    draws = F.transform(weights, lambda w, i: F.struct(_draw(key, F.concat(prefix, F.lit("/"), i.cast("string")), w).alias("d"), i.alias("i")))
    return F.array_min(draws)["i"]


def _lookup(values: list, *at: Column) -> Column:
    """A nested list of constants, indexed by columns."""

    def literal(x) -> Column:
        return F.array(*[literal(y) for y in x]) if isinstance(x, list) else F.lit(x)

    out = literal(values)
    for a in at:
        out = F.get(out, a)
    return out


def _padded(tree: Tree) -> tuple[list[list[float]], list[list[list[float]]], list[list[list[int]]]]:
    """Weights of racks and of shards, and shard numbers, padded to rectangles; what is padded weighs 0."""
    racks, shards = max(len(r) for r in tree), max(len(k) for r in tree for k in r)
    number = count()
    weights = [[[*k, *[0.0] * (shards - len(k))] for k in [*r, *[[]] * (racks - len(r))]] for r in tree]
    ids = [[[*[next(number) for _ in k], *[-1] * (shards - len(k))] for k in [*r, *[[]] * (racks - len(r))]] for r in tree]
    return [[sum(k) for k in r] for r in weights], weights, ids


def placed(df: DataFrame, key: Column, tree: Tree, region: str, rack: str, shard: str) -> DataFrame:
    """The rows with the numbers of their region, rack and shard."""
    rack_weights, shard_weights, ids = _padded(tree)
    df = df.withColumn(region, _chosen(key, F.lit("region"), _lookup([sum(r) for r in rack_weights])))
    at = F.concat(F.lit("rack/"), F.col(region).cast("string"))
    df = df.withColumn(rack, _chosen(key, at, _lookup(rack_weights, F.col(region))))
    at = F.concat(F.lit("shard/"), F.col(region).cast("string"), F.lit("/"), F.col(rack).cast("string"))
    leaf = _chosen(key, at, _lookup(shard_weights, F.col(region), F.col(rack)))
    return df.withColumn(shard, _lookup(ids, F.col(region), F.col(rack), leaf))


#: Slots of equal rows that one task puts out in a row.
PIECE = 10_000


def numbered(df: DataFrame, group: str, place: Column, ties: list[str], slot: str, buckets: int = 1024) -> DataFrame:
    """The rows with a slot, gapless from 0 in each group, in the order of place (52 bits) and then of ties."""
    at, bucket, n, first, before, piece = (fresh(c, [*df.columns, slot]) for c in ("place", "bucket", "n", "first", "before", "piece"))
    spread = df.withColumn(at, place).withColumn(bucket, F.floor(F.col(at) / F.lit(_UNIT / buckets)).cast("int"))
    rows = written(spread.groupBy(*spread.columns).agg(F.count("*").alias(n)), "numbered")
    counts = rows.groupBy(group, bucket).agg(F.sum(n).alias(n))
    start = F.sum(n).over(Window.partitionBy(group).orderBy(bucket)) - F.col(n)
    starts = counts.select(group, bucket, start.alias(first))
    upto = Window.partitionBy(group, bucket).orderBy(at, *ties, F.hash(*df.columns)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn(before, F.sum(n).over(upto) - F.col(n)).join(starts, [group, bucket])
    pieces = ranked.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(PIECE).cast("long")))).repartition(group, bucket, piece)
    left = F.least(F.col(n) - F.col(piece), F.lit(PIECE)) - 1
    each = pieces.withColumn(slot, F.explode(F.sequence(F.col(first) + F.col(before) + F.col(piece), F.col(first) + F.col(before) + F.col(piece) + left)))
    return each.select(*df.columns, F.col(slot).cast("long").alias(slot))


def key_text(column: str = "doc_id") -> Column:
    """The key as text; null draws as "null"."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def write_shards(docs: DataFrame, tree: Tree, path: str) -> None:
    """Writes the documents to one folder for each shard."""
    placed(docs, key_text(), tree, "region", "rack", "shard").drop("region", "rack").write.partitionBy("shard").parquet(path)


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal weight: 4 regions of 2 racks of 2 shards; and with a 17th shard."""
    tree = even_tree(4, 2, 2)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    docs = placed(docs, key_text(), tree, "region", "rack", "shard")
    docs = placed(docs, key_text(), grown(tree), "grown_region", "grown_rack", "grown_shard").drop("grown_region", "grown_rack")
    place = F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), key_text(), F.lit("|"), F.col("text_crc32").cast("string"))), 1, 13), 16, 10).cast("long")
    docs = numbered(docs, "shard", place, ["doc_id", "text_crc32", "size"], "slot")
    return docs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def _sql_choice(name: str, prefix: str, weights: list[str]) -> str:
    draws = [f"{{'d': -ln((('0x' || substr(md5({prefix} || '/{i}|' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {w}, 'i': {i}}}" for i, w in enumerate(weights)]
    return f"list_min([{', '.join(draws)}]).i AS {name}"


OP2_SQL = f"""
    WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
    d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') k, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
    e AS (SELECT doc_id, k, size, xor(list_reduce(list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, crc),
    r AS (SELECT *, {_sql_choice("region", "'region'", ["4.0::DOUBLE"] * 4)}, {_sql_choice("grown_region", "'region'", ["4.0::DOUBLE"] * 4 + ["1.0::DOUBLE"])} FROM e),
    q AS (SELECT *, {_sql_choice("rack", "'rack/' || region", ["2.0::DOUBLE"] * 2)} FROM r),
    s AS (SELECT *, {_sql_choice("leaf", "'shard/' || region || '/' || rack", ["1.0::DOUBLE"] * 2)} FROM q),
    p AS (SELECT *, region * 4 + rack * 2 + leaf AS shard, ('0x' || substr(md5('slot|' || k || '|' || text_crc32), 1, 13))::BIGINT AS place FROM s)
    SELECT doc_id, size::BIGINT size, text_crc32::BIGINT text_crc32, 'key' law, shard::INT shard,
        row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot,
        (CASE WHEN grown_region = 4 THEN 16 ELSE shard END)::INT grown_shard, region::INT region, rack::INT rack
    FROM p
"""
