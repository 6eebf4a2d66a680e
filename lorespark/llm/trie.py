"""Prefix trie of conversations, built level by level and rolled up again.

A node is a distinct sequence of first turns; the conversations that start with it
are its members, and its name is the smallest of them, with its depth.

1. Turns are ordered and hashed once (128 bits of role and text); after that no text
   moves.
2. Down: at each depth the live conversations are grouped by (parent, next turn), and
   a group's smallest id names the node.  A conversation that is alone in its node
   leaves: the rest of it is a path of its own, written out at the end without
   further levels.  So the levels end with the deepest turn that two share.
3. Up: level by level, children are summed by parent and joined to their nodes.

Groups are counted before they move, and a level's nodes are written before
conversations join them, so a first turn that a third of all conversations share is
a skewed join that Spark splits.  The ids that end in one node meet in blocks of
``BLOCK`` consecutive ids; a node's blocks are hashed as a stream.

Defined results: a null role or text is empty, rows without a conv_id are left out,
turns go by number (null first), then role, then text; repeated rows are turns of
their own; an empty table gives no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Levels, materialize, prepare, table

#: Consecutive ids whose decimals are joined before they move on.
BLOCK = 4096
#: Turns of a base conversation that a rebuilt one may take.
MOST_HEAD = 8

_STEPS = "parent long, key binary, conv_id long, length int, n_bytes long"
_NODES = "parent long, key binary, node long, length int, n_bytes long, n_convs long"
_SUMS = "node long, parent long, n_convs long, n_children long, n_leaves long, saved long"
_HASHED = "depth int, node long, ends_sha256 string"


def ordered_turns(convs: DataFrame) -> DataFrame:
    """``conv_id, pos, key, n_bytes``: turns in order from 1, texts as hashes.

    Texts take part in the order only where a conversation has the same turn twice."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = convs.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    again = materialize(rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id", F.col("turn").alias("again"), F.lit(True).alias("tied")), "ties")
    by = ["role"]
    if not again.isEmpty():
        same = (rows.conv_id == again.conv_id) & rows.turn.eqNullSafe(again.again)
        rows = rows.join(again, same, "left").select(rows["*"], F.when(F.col("tied"), rows.text).alias("tie"))
        by.append("tie")
    turns = rows.select("conv_id", "turn", *by, key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), *by))
    return materialize(turns.select("conv_id", pos.alias("pos"), "key", "n_bytes"), "turns")


def rebuilt(turns: DataFrame, head: F.Column, base: F.Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns (at most ``MOST_HEAD``) are replaced by
    those of conversation ``base``, both columns of ``conv_id``.

    Returns (conv_id, length) and (conv_id, depth, key, n_bytes)."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", head.cast("int").alias("h"), base.alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    members = sizes.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    members = materialize(members, "members")
    own = turns.join(members, "conv_id").filter("pos > h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "key", "n_bytes")
    firsts = turns.filter(F.col("pos") <= MOST_HEAD).withColumnRenamed("conv_id", "base")
    taken_ = members.filter("k > 0").join(firsts, "base").filter("pos <= k").select("conv_id", F.col("pos").alias("depth"), "key", "n_bytes")
    return members.select("conv_id", "length"), own.unionByName(taken_)


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form of ``rebuilt``."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("length")), turns.withColumnRenamed("pos", "depth")


def _band(depth: F.Column | int) -> F.Column | int:
    """Depths of a band are read together: 0 to 15, 16 to 31, 32 to 63, ..."""
    if isinstance(depth, int):
        return max(4, depth.bit_length())
    return F.greatest(F.lit(4), F.floor(F.log2(depth)).cast("int") + 1)


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a node come together and in order."""
    last, digest = None, None

    def row() -> pa.RecordBatch:
        arrays = [pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int64()), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "node", "ends_sha256"])

    for batch in batches:
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
            if (depth, node) == last:
                digest.update(b"," + ids.encode())
                continue
            if last is not None:
                yield row()
            last, digest = (depth, node), hashlib.sha256(ids.encode())
    if last is not None:
        yield row()


def _ends(ended: DataFrame) -> DataFrame:
    """``depth, node, ends_sha256`` of (depth, node, conv_id)."""
    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids")
    blocks = ended.groupBy("depth", "node", block).agg(ids)
    return blocks.repartition("depth", "node").sortWithinPartitions("depth", "node", "block").mapInArrow(_hash_blocks, _HASHED)


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of ``members`` (conv_id, length) and ``turns`` (conv_id, depth from 1, key,
    n_bytes), a row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``."""
    spark = prepare(members.sparkSession)
    members = members.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("length").cast("int").alias("length"))
    root, n_all = members.agg(F.min("conv_id"), F.count("*")).first()
    sequences = Levels(spark, "conv_id long, depth int, key binary, n_bytes long", "sequences", "band")
    sequences.split(turns.select("conv_id", F.col("depth").cast("int").alias("depth"), "key", F.col("n_bytes").cast("long").alias("n_bytes"), _band(F.col("depth")).alias("band")))
    steps, nodes, sums = Levels(spark, _STEPS, "steps"), Levels(spark, _NODES, "nodes"), Levels(spark, _SUMS, "sums")

    live = members.filter("length > 0").select("conv_id", "length", F.lit(root).cast("long").alias("parent"))
    depth = 0
    while True:
        depth += 1
        following = sequences.at(_band(depth)).filter(F.col("depth") == depth).select("conv_id", "key", "n_bytes")
        step = steps.put(depth, live.join(following, "conv_id").select("parent", "key", "conv_id", "length", "n_bytes"))
        level = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.max("length").alias("length"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_convs"))
        level = nodes.put(depth, level.select("parent", "key", "node", "length", "n_bytes", "n_convs"))
        if level.filter("n_convs > 1").isEmpty():
            break
        shared = level.filter("n_convs > 1").select("parent", "key", "node")
        live = step.filter(F.col("length") > depth).join(shared, ["parent", "key"]).select("conv_id", "length", F.col("node").alias("parent"))

    def children(d: int) -> DataFrame:
        alone = nodes.at(d).filter("n_convs = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
        return alone if d == depth else alone.unionByName(sums.at(d).select("parent", "n_leaves", "saved"))

    totals = [F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below")]
    zero = lambda c, least=0: F.coalesce(F.col(c), F.lit(least)).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("n_bytes") + zero("below")
    rolled = [zero("n_children").alias("n_children"), zero("leaves", 1).alias("n_leaves")]
    for d in range(depth - 1, 0, -1):
        below = children(d + 1).groupBy("parent").agg(*totals).withColumnRenamed("parent", "node")
        sums.put(d, nodes.at(d).filter("n_convs > 1").join(below, "node", "left").select("node", "parent", "n_convs", *rolled, saved.alias("saved")))

    top = children(1).agg(*totals).select(F.lit(root).cast("long").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(n_all).cast("long").alias("n_convs"), *rolled, zero("below").alias("saved"))
    ended = steps.all().filter("length = depth").join(nodes.all().filter("n_convs > 1").select("depth", "parent", "key", "node"), ["depth", "parent", "key"]).select("depth", "node", "conv_id")
    turnless = members.filter("length = 0").select(F.lit(0).alias("depth"), F.lit(root).cast("long").alias("node"), "conv_id")
    ends = _ends(ended.unionByName(turnless))
    inner = top.filter("node IS NOT NULL").unionByName(sums.all().select("node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved"))
    nobody = F.lit(hashlib.sha256().hexdigest())
    inner = inner.join(ends, ["depth", "node"], "left").select("node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))

    paths = nodes.all().filter("n_convs = 1").select("node", F.col("depth").alias("first"), F.col("parent").alias("above"), "length", F.explode(F.sequence("depth", "length")).alias("depth"))
    last = F.col("depth") == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    paths = paths.select("node", "depth", F.when(F.col("depth") == F.col("first"), F.col("above")).otherwise(F.col("node")).alias("parent"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved"), F.when(last, F.sha2(F.col("node").cast("string"), 256)).otherwise(nobody).alias("ends_sha256"))
    return inner.unionByName(paths).select(F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def conversation_trie(convs: DataFrame, head: F.Column | None = None, base: F.Column | None = None) -> DataFrame:
    """The trie of a conversation table (conv_id, turn, role, text), as it is or rebuilt."""
    turns = ordered_turns(prepare(convs.sparkSession) and convs)
    return prefix_trie(*(whole(turns) if head is None else rebuilt(turns, head, base)))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    head = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(9))
    return conversation_trie(table(spark, sf_dir, "conversations"), head, conv - F.pmod(conv, F.lit(5)))


OP13_SQL = """
WITH RECURSIVE bits(n, c, k) AS (
    SELECT n, n, 0 FROM range(256) t(n)
    UNION ALL
    SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY n) AS crc FROM bits WHERE k = 8),
crcs(conv_id, digits, i, c) AS (
    SELECT conv_id, conv_id::VARCHAR, 1, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
    UNION ALL
    SELECT conv_id, digits, i + 1, xor(c >> 8, crc[xor(c & 255, ascii(digits[i])) + 1]) FROM crcs, steps WHERE i <= length(digits)),
heads AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crcs WHERE i = length(digits) + 1),
original AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) AS turns
    FROM original o JOIN heads USING (conv_id) LEFT JOIN original b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (SELECT conv_id, len(turns) AS length, d AS depth, turns[1:d] AS prefix FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY ALL),
tied AS (
    SELECT n.*, p.conv_id AS parent_conv_id, p.depth AS above, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children,
        CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.prefix[-1].text) END AS saved
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
ancestors AS (SELECT depth AS below, n_children, saved, unnest(range(depth + 1)) AS depth, prefix FROM tied),
sums AS (SELECT depth, prefix[1:depth] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM ancestors GROUP BY ALL)
SELECT t.conv_id, t.depth, t.parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, t.ends_sha256
FROM tied t JOIN sums s USING (depth, prefix)
"""
