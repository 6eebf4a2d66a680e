"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is 60 bits of the MD5 of its key.  The directory starts as one
bucket; a bucket whose bytes exceed the limit splits on the next bit of the
prefix, and only such buckets split.  Sizes come from one aggregation of hash
prefixes (``STEP`` bits finer than an even spread needs), rolled up to the next
shorter prefixes, and to the others from 4,096 times fewer; a bucket that is still too large at the finest prefix is taken
``STEP`` bits further, with its own rows only.

Defined results: a null text counts 0 bytes and a null key hashes as the empty
text; rows that repeat the whole key have one hash and can't be told apart, so a
bucket of these alone (or one row above the limit) is returned whole and flagged
``oversize``; an empty table gives an empty result; the rows carry further
columns only on request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, prepare, table

BITS = 60
STEP = 6
#: Bytes of a shard; the query makes smaller ones, so that small tables split too.
LIMIT = 256 << 20
QUERY_LIMIT = 1 << 20


def row_hash(*keys: Column) -> Column:
    """60 bits of the MD5 of the key columns' texts."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def shards(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The directory for ``rows`` (``hash, bytes``): ``hash`` of each row and its
    bucket (``depth, prefix, shard_bytes, shard_rows, oversize``)."""
    points = rows.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    points = materialize(points, "points")
    total = points.agg(F.sum("bytes"), F.count("*")).first()
    even = max(0, (int(total[0] or 0) // limit).bit_length())
    depth, found, left = min(BITS, even + STEP), [], points
    top = 0
    while True:
        cut = lambda d: F.expr(f"shiftright(hash, {BITS - d})")
        fine = materialize(left.groupBy(cut(depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("kinds")), "fine")
        low = max(top, depth - 2 * STEP)
        coarse = fine.groupBy(F.expr(f"shiftright(cell, {depth - low})").alias("cell")).agg(*(F.sum(c).alias(c) for c in ("bytes", "n", "kinds")))
        # the cells' prefixes of all lengths: (of, cells' bits, shortest, longest)
        spans = [(fine, depth, low, depth)] + ([(coarse, low, top, low - 1)] if top < low else [])
        nodes = [cells.withColumn("depth", F.explode(F.sequence(F.lit(a), F.lit(b)))).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)")) for cells, bits, a, b in spans]
        sizes = reduce(DataFrame.unionByName, (x.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.sum("kinds").alias("kinds")) for x in nodes))
        fits = materialize(sizes.filter((F.col("shard_bytes") <= limit) | (F.col("kinds") == 1)), "fits")
        # no bucket is shallower than this, so no short prefix gathers all rows
        least = fits.agg(F.min("depth")).first()[0]
        least = top if least is None else least
        at = left.withColumn("b", F.lit(None).cast("struct<depth: int, prefix: bigint, shard_bytes: bigint, shard_rows: bigint>"))
        for x, (_, bits, _, longest) in reversed(list(zip(nodes, spans, strict=True))):
            if longest >= least:
                mine = x.select("cell", "depth", "prefix").filter(F.col("depth") >= least).join(fits, ["depth", "prefix"])
                mine = mine.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("c"))
                at = at.withColumn("cell", cut(bits)).join(mine, "cell", "left").select("hash", "bytes", "n", F.coalesce("b", "c").alias("b"))
        at = materialize(at, "placed")
        forget(fine)
        forget(fits)
        found.append(at.filter("b is not null").select("hash", "b.*"))
        left = at.filter("b is null").select("hash", "bytes", "n")
        if left.isEmpty():
            break
        top, depth = depth + 1, min(BITS, depth + STEP)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("oversize", F.col("shard_bytes") > limit)


def assign_shards(df: DataFrame, keys: list[str] | None = None, size: str = "text", limit: int = LIMIT, carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` (``doc_id`` unless given), ``n_bytes``, and the
    row's shard: its bits as text, their number, and its bytes and rows."""
    prepare(df.sparkSession)
    hashed = row_hash(*(F.col(k) for k in keys or ["doc_id", "text"]))
    rows = df.select(*(carry or ["doc_id"]), F.coalesce(F.octet_length(size), F.lit(0)).cast("long").alias("n_bytes"), hashed.alias("_hash"))
    where = shards(rows.select(F.col("_hash").alias("hash"), F.col("n_bytes").alias("bytes")), limit)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return rows.join(where, F.col("_hash") == F.col("hash")).select(*(carry or ["doc_id"]), "n_bytes", bits.alias("shard"), F.col("depth").alias("n_bits"), "shard_bytes", "shard_rows", "oversize")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), limit=QUERY_LIMIT)


OP5_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
points AS (SELECT h, sum(n_bytes)::BIGINT AS b, count(*) AS n FROM rows_ GROUP BY h),
placed(depth, h, b, n, sb, sn, kinds) AS (
  SELECT 0, h, b, n, (sum(b) OVER ())::BIGINT, (sum(n) OVER ())::BIGINT, count(*) OVER () FROM points
  UNION ALL
  SELECT depth + 1, h, b, n, (sum(b) OVER w)::BIGINT, (sum(n) OVER w)::BIGINT, count(*) OVER w
  FROM placed WHERE sb > {QUERY_LIMIT} AND kinds > 1
  WINDOW w AS (PARTITION BY h >> ({BITS} - depth - 1))),
leaf AS (SELECT * FROM placed WHERE sb <= {QUERY_LIMIT} OR kinds = 1)
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(format('{{:060b}}', leaf.h), 60)[1:depth] END AS shard,
       depth AS n_bits, sb AS shard_bytes, sn AS shard_rows, sb > {QUERY_LIMIT} AS oversize
FROM rows_ JOIN leaf USING (h)
"""
