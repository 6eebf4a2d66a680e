"""Entities and items as graphs: edges, neighbours, threads, traversal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..session import dealt, scratch


def pairs(members: DataFrame, item: str = "item_id", entity: str = "entity_id") -> DataFrame:
    """(item, a, b) of the entities that meet in an item, a < b; members may repeat.  Items
    are taken as arrays, so a pair is made where its item is."""
    return _pairs(members, members.count(), item, entity)


def _pairs(members: DataFrame, count: int, item: str, entity: str) -> DataFrame:
    met = dealt(members.select(item, entity), count, item).groupBy(item).agg(F.sort_array(F.collect_set(entity)).alias("e")).filter(F.size("e") > 1)
    first = met.select(item, "e", F.posexplode("e").alias("i", "a"))
    return first.select(item, "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))


def cooccurrence_edges(members: DataFrame) -> DataFrame:
    """Edges with counts and confidence: .5 and .1 for each further item, at most 1.
    Members are counted, and they and their pairs (about two a member where items have some
    five) dealt by that, so that a task's memory stays the same as the table grows."""
    count = members.count()
    met = dealt(_pairs(members, count, "item_id", "entity_id").select("a", "b"), 2 * count, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return met.withColumn("confidence", F.least(F.lit(1.0), F.round(0.5 + 0.1 * (F.col("n") - 1), 6)))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends; the edges are read once."""
    end = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col("n"))
    return edges.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("e.*")


def top_neighbours(edges: DataFrame, k: int = 10, count: int = 0) -> DataFrame:
    """Each entity's ``k`` most met; ``count``, where it is known, tells how many ends of edges
    there are about, to be dealt by."""
    ends = symmetric(edges)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return (dealt(ends, count, "a") if count else ends).withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("a").alias("entity_id"), F.col("b").alias("neighbour"), "n", "rank")


#: Entities of a block of those who meet, and of those whom they meet.
MEETING, MET = 5_000, 50_000


def most_met(members: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(entity_id, other, n): for each entity the ``k`` of ``others`` (``entity_id``) that it
    meets in the most items, ties by the smaller id.  Ids are whole numbers.

    Edges may be as many as pairs of entities, so none is kept: a block of entities meets a
    block of others at a time, and each entity's best of the block come out.  A block is
    moved packed: its items, how many it has of each, and which."""
    own = members.select("item_id", "entity_id").distinct()
    known = own.join(others.select("entity_id").distinct(), "entity_id", "left_semi")
    met, meeting = _packed(known, MET), _packed(own, MEETING)
    sides = meeting.select("block", F.col("packed").alias("left")).crossJoin(met.select(F.col("block").alias("with_block"), F.col("packed").alias("right")).hint("shuffle_replicate_nl"))
    best = sides.repartition(F.col("block"), F.col("with_block")).mapInArrow(_best_of_blocks(k), "entity_id long, other long, n long")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "other"))
    return best.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def _packed(members: DataFrame, size: int) -> DataFrame:
    """(block, packed): entities in blocks of about ``size``, with their items."""
    n = members.agg(F.countDistinct("entity_id")).first()[0]
    blocks = -(-n // size) or 1

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "entity_id"])
        ids, which = np.unique(rows.entity_id.to_numpy(), return_inverse=True)
        items, counts = np.unique(rows.item_id.to_numpy(), return_counts=True)
        parts = [ids.astype("<i8"), items.astype("<i8"), counts.astype("<i4"), which.astype("<i4")]
        return pd.DataFrame({"block": rows.block.iloc[:1], "packed": [b"".join([np.array([len(ids), len(items)], "<i8").tobytes(), *(x.tobytes() for x in parts)])]})

    dealt = members.withColumn("block", F.pmod(F.xxhash64("entity_id"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("block").applyInPandas(pack, "block int, packed binary")
    return packed.coalesce(blocks)  # each partition of one side meets each of the other, empty ones too


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, items, where each item's entities begin, entities by their place among the ids)."""
    n, m = np.frombuffer(blob, "<i8", 2)
    ids, items = np.frombuffer(blob, "<i8", n, 16), np.frombuffer(blob, "<i8", m, 16 + 8 * n)
    counts = np.frombuffer(blob, "<i4", m, 16 + 8 * (n + m))
    return ids, items, np.concatenate([[0], np.cumsum(counts)]), np.frombuffer(blob, "<i4", -1, 16 + 8 * (n + m) + 4 * m)


def _best_of_blocks(k: int):
    import pyarrow as pa

    def best(left: bytes, right: bytes):
        ids, items, begin, which = _unpacked(left)
        others, theirs, their_begin, whom = _unpacked(right)
        of = np.repeat(np.arange(len(items)), np.diff(begin))
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(len(ids) + 1))
        at = np.searchsorted(theirs, items)
        held = at < len(theirs)
        held[held] = theirs[at[held]] == items[held]
        self_at = np.searchsorted(others, ids)
        for e in range(len(ids)):
            found = [whom[their_begin[at[i]] : their_begin[at[i] + 1]] for i in of[order[ends[e] : ends[e + 1]]] if held[i]]
            if not found:
                continue
            n = np.bincount(np.concatenate(found), minlength=len(others))
            if self_at[e] < len(others) and others[self_at[e]] == ids[e]:
                n[self_at[e]] = 0
            many = np.bincount(n)
            least = max(1, int(np.searchsorted(-np.cumsum(many[::-1])[::-1], -k, side="right")) - 1)
            top = np.flatnonzero(n > least)
            top = np.concatenate([top, np.flatnonzero(n == least)[: max(0, k - len(top))]])
            yield ids[e], others[top], n[top]

    def work(batches):
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                rows = list(best(left.as_py(), right.as_py()))
                if rows:
                    e = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype("i8")) for x in (e, np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]))], ["entity_id", "other", "n"])

    return work


def shared_contacts(members: DataFrame, least: int = 2, common: float = 0.3) -> DataFrame:
    """Pairs of items with ``least`` or more shared entities, those in more than a
    share ``common`` of all items aside; confidence is the share of the larger."""
    own = members.select("item_id", "entity_id").distinct()
    total = own.agg(F.countDistinct("item_id").alias("items"))
    wide = own.groupBy("entity_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).filter(F.col("n") > common * F.col("items")).select("entity_id")
    kept = own.join(wide, "entity_id", "left_anti")
    met = _sharing(kept, least)
    return met.select(F.col("id").alias("item_a"), F.col("id_b").alias("item_b"), "shared", F.round(F.col("shared") / F.greatest("size", "size_b"), 2).alias("confidence"))


#: Entities of an item up to which its items are found by pairs of entities.
WIDE = 32


def _sharing(members: DataFrame, least: int) -> DataFrame:
    """(id, size, id_b, size_b, shared) of items, id < id_b, with ``least`` (two or more)
    common entities.

    Each pair of an item's entities is a key, and items of one key meet: those that share
    n entities do so n * (n - 1) / 2 times, which tells n, so nothing but ids is moved.  An
    item of more than ``WIDE`` entities has too many pairs and meets all others by its
    single entities."""
    own = members.select("item_id", "entity_id").distinct()
    sets = own.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_list("entity_id")).alias("items")).filter(F.size("items") >= least)
    small = sets.filter(F.size("items") <= WIDE).select("id", F.size("items").cast("long").alias("size"), "items")
    one = small.select("id", "size", "items", F.posexplode("items").alias("i", "p"))
    keys = one.select("id", "size", "p", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("q"))
    other = keys.select("p", "q", F.col("id").alias("id_b"), F.col("size").alias("size_b"))
    met = keys.hint("merge").join(other, ["p", "q"]).filter("id < id_b").groupBy("id", "size", "id_b", "size_b").agg(F.count("*").alias("pairs"))
    found = met.withColumn("shared", F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("long")).drop("pairs")
    placed = sets.select("id", F.size("items").cast("long").alias("size"), F.explode("items").alias("entity"))
    wide = placed.filter(F.col("size") > WIDE).select(F.col("id").alias("w"), F.col("size").alias("w_size"), "entity")
    across = placed.join(wide, "entity").filter((F.col("id") < F.col("w")) | ((F.col("id") > F.col("w")) & (F.col("size") <= WIDE)))
    swap = F.col("id") > F.col("w")
    sides = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("id", "w", "id"), ("size", "w_size", "size"), ("id_b", "id", "w"), ("size_b", "size", "w_size"))]
    far = across.select(*sides).groupBy("id", "size", "id_b", "size_b").agg(F.count("*").alias("shared"))
    return found.unionByName(far).filter(F.col("shared") >= least)


def follow_ups(items: DataFrame, thread: str, order: str, item: str = "id") -> DataFrame:
    """Each item and the next of its thread."""
    after = F.lead(item).over(Window.partitionBy(thread).orderBy(order, item))
    return items.filter(F.col(thread).isNotNull()).select(thread, F.col(item).alias("source_id"), after.alias("target_id")).filter("target_id is not null")


#: Vectors of a block that are compared with another block's as matrices.
BLOCK = 2_000


def related(vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs of items of one project (or of none) with a cosine above the threshold.

    A project's vectors are dealt to blocks of bounded size; each pair of blocks is one
    product of matrices, of which only what is above the threshold comes out."""
    own = vectors.select("id", F.coalesce(F.col("project").cast("string"), F.lit("")).alias("p"), "embedding")
    sizes = own.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = own.join(sizes, "p").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    with_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = placed.select("id", "p", "embedding", "block", with_).select("id", "p", "embedding", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = vectors.schema["id"].dataType.simpleString()
    found = sent.groupBy("p", "i", "j").applyInPandas(_products(threshold), f"a {kind}, b {kind}, score double")
    return found


def _products(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.embedding.notna()].sort_values("id")
        i, j = rows.i.iloc[:1].tolist() + rows.j.iloc[:1].tolist() if len(rows) else (0, 0)
        left, right = rows[rows.block == i], rows[rows.block == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": rows.id[:0], "b": rows.id[:0], "score": np.zeros(0)})

        def unit(x: pd.DataFrame) -> np.ndarray:
            m = np.stack(x.embedding.to_list()).astype(float)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)

        score = (unit(left) @ unit(right).T).round(6)
        x, y = left.id.to_numpy()[:, None], right.id.to_numpy()[None]
        at = np.nonzero((score > threshold) & ((x < y) if i == j else np.ones_like(score, bool)))
        a, b = left.id.to_numpy()[at[0]], right.id.to_numpy()[at[1]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score[at]})

    return work


def supersedes(items: DataFrame, threshold: float) -> DataFrame:
    """Newer to older item of a project with a shared contact and alike vectors.

    ``items``: id, project, at, contacts (array), embedding."""
    pairs = related(items.filter(F.col("project").isNotNull()), threshold)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    new = items.select(F.col("id").alias("a"), "at", "contacts")
    old = items.select(F.col("id").alias("b"), F.col("at").alias("old_at"), F.col("contacts").alias("old_contacts"))
    later = both.join(new, "a").join(old, "b").filter((F.col("at") > F.col("old_at")) & F.arrays_overlap("contacts", "old_contacts"))
    return later.select(F.col("a").alias("id"), F.col("b").alias("old_id"), "score", F.lit(0.8).alias("confidence"))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth) reached from the start nodes, each at its first visit."""
    both = symmetric(edges).select("a", "b")
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen.select("node")
    for d in range(1, depth + 1):
        new = both.join(frontier, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(new.withColumn("depth", F.lit(d)))
        frontier = new
    return seen


def thread_candidates(members: DataFrame, items: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Pairs of items that look like one story.

    ``members``: item_id, entity_id; ``items``: id, project, source, day."""
    shared = _sharing(members, 2).select(F.col("id").alias("item_id"), F.col("id_b").alias("item_b"), "shared")
    a = items.select(F.col("id").alias("item_id"), "project", "source", "day")
    b = items.select(F.col("id").alias("item_b"), F.col("project").alias("project_b"), F.col("source").alias("source_b"), F.col("day").alias("day_b"))
    days = F.abs(F.datediff("day", "day_b"))
    score = (
        0.4 * F.least(F.col("shared") / 3, F.lit(1.0))
        + F.when(F.col("project") == F.col("project_b"), 0.25).otherwise(0.0)
        + F.when(days <= 2, 0.2).when(days <= 7, 0.15).when(days <= 14, 0.08).otherwise(0.0)
        + F.when(F.col("source") != F.col("source_b"), 0.15).otherwise(0.0)
    )
    scored = shared.join(a, "item_id").join(b, "item_b").select(F.col("item_id").alias("a"), F.col("item_b").alias("b"), "shared", F.round(score, 6).alias("score"))
    return scored.filter(F.col("score") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by smallest nodes.  Two contractions alternate until nothing
    changes: every node links its larger neighbours to its smallest one, then its
    smaller neighbours to it.  Each round is written to the shared folder and the one
    before it deleted; whether anything changed is told by counts and sums of hashes."""
    spark = edges.sparkSession

    def settle(rows: DataFrame, old: str | None) -> tuple[DataFrame, str]:
        path = scratch(spark, "links")
        rows.write.parquet(path)
        if old:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return spark.read.schema(rows.schema).parquet(path), path

    def state(rows: DataFrame) -> tuple:
        wide = lambda c: F.sum(c.cast("decimal(38,0)"))
        return tuple(rows.agg(F.count("*"), wide(F.xxhash64("u", "v")), wide(F.xxhash64("v", "u"))).first())

    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    every, _ = settle(edges.filter("a is not null and b is not null").select(u, v).distinct(), None)
    links, path = every.filter("u <> v"), None
    now = state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star, path = settle(star, path)
        small = star.join(star.groupBy("u").agg(F.min("v").alias("m")), "u")
        links, path = settle(small.select("u", F.col("m").alias("v")).unionByName(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), path)
        before, now = now, state(links)
        if now == before:
            break
    roots = links.select("v").distinct()
    alone = every.filter("u = v").select("u").join(links.select("u").unionByName(roots.withColumnRenamed("v", "u")), "u", "left_anti")
    return (
        links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .unionByName(alone.select(F.col("u").alias("node"), F.col("u").alias("component")))
    )


def threads(candidates: DataFrame) -> DataFrame:
    """Clusters of accepted pairs: three items, or two that share three entities."""
    path = scratch(candidates.sparkSession, "candidates")  # read twice
    candidates.write.parquet(path)
    candidates = candidates.sparkSession.read.schema(candidates.schema).parquet(path)
    part = components(candidates)
    size = part.groupBy("component").agg(F.count("*").alias("items"))
    strong = candidates.filter("shared >= 3").join(part, F.col("a") == F.col("node")).select("component").distinct().withColumn("strong", F.lit(True))
    kept = size.join(strong, "component", "left").filter("items >= 3 or (items = 2 and strong)").select("component", "items")
    return part.join(kept, "component").select("component", "items", "node")


def thread_clusters(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(component, items, sources, score) of the clusters that ``threads`` keeps: .3 for each
    item and .2 for each source.  ``items``: id, source."""
    kept = threads(candidates).join(items.select(F.col("id").alias("node"), "source"), "node")
    found = kept.groupBy("component").agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"))
    return found.withColumn("score", F.round(0.3 * F.col("items") + 0.2 * F.col("sources"), 6))


def confident_neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth, confidence) reached from the start nodes, each at its first visit with
    its surest path of that length: the product of its edges' confidence.

    ``edges``: a, b, confidence.  A level is written before the next one reads it."""
    spark = edges.sparkSession
    both = edges.select("a", "b", "confidence").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    folder = scratch(spark, "levels")
    schema = start.select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence")).schema
    start.select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence")).distinct().write.parquet(f"{folder}/0")
    levels = [f"{folder}/0"]
    for d in range(1, depth + 1):
        seen, last = spark.read.schema(schema).parquet(*levels), spark.read.schema(schema).parquet(levels[-1])
        reached = both.join(last.select(F.col("node").alias("a"), F.col("confidence").alias("so_far")), "a")
        new = reached.groupBy(F.col("b").alias("node")).agg(F.max(F.col("so_far") * F.col("confidence")).alias("confidence")).join(seen, "node", "left_anti")
        new.select("node", F.lit(d).alias("depth"), "confidence").write.parquet(f"{folder}/{d}")
        levels.append(f"{folder}/{d}")
    return spark.read.schema(schema).parquet(*levels).orderBy(F.desc("confidence"), "depth", "node")


def merge_entities(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """Repoint members by (old_id, new_id) and drop what repeats."""
    to = F.coalesce("new_id", "entity_id")
    return members.join(mapping, F.col("entity_id") == F.col("old_id"), "left").select("item_id", to.alias("entity_id")).distinct()


def mail_duplicates(entities: DataFrame) -> DataFrame:
    """(old_id, new_id) of entities of one address, onto the smallest id."""
    first = F.min("id").over(Window.partitionBy(F.lower("email")))
    return entities.filter("email is not null").withColumn("new_id", first).filter("id <> new_id").select(F.col("id").alias("old_id"), "new_id")


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The entity of each name (``name, normal, email``) by the first tier that
    matches: exact name, address, normal name, alias, prefix (not dismissed)."""
    seen = ["last_seen"] if "last_seen" in entities.columns else []
    e = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("e_name"), F.col("normal").alias("e_normal"), F.col("email").alias("e_email"), "dismissed", *seen)
    tier = lambda found, k: found.groupBy("name").agg(F.min("entity_id").alias("entity_id")).withColumn("tier", F.lit(k))
    every = (
        tier(names.join(e, F.col("name") == F.col("e_name")), 1)
        .unionByName(tier(names.join(e, F.lower("email") == F.lower("e_email")), 2))
        .unionByName(tier(names.join(e, F.col("normal") == F.col("e_normal")), 3))
        .unionByName(tier(names.join(aliases.select("entity_id", "alias"), F.col("normal") == F.col("alias")), 4))
        .unionByName(_by_prefix(names, e).withColumn("tier", F.lit(5)))
    )
    return every.groupBy("name").agg(F.min(F.struct("tier", "entity_id")).alias("m")).select("name", "m.entity_id", "m.tier")


def _by_prefix(names: DataFrame, e: DataFrame) -> DataFrame:
    """(name, entity_id): the entity whose normal name begins with a name's, the one seen
    last of several (the smallest id where none is known).  Each entity's beginnings of the
    lengths that names have are dealt out, and one entity kept for each beginning."""
    asked = names.filter(~F.col("name").contains("@"))
    lengths = asked.select(F.length("normal").alias("length")).distinct()
    held = e.filter(~F.col("dismissed") & ~F.col("e_name").contains("@")).crossJoin(F.broadcast(lengths)).filter(F.length("e_normal") >= F.col("length"))  # a row for each length of a name
    begun = held.withColumn("beginning", F.expr("left(e_normal, length)"))
    seen = ["last_seen"] if "last_seen" in e.columns else []
    first = begun.groupBy("beginning", *seen).agg(F.min("entity_id").alias("entity_id"))
    if seen:  # the latest, nulls last, then the smallest id
        first = first.groupBy("beginning").agg(F.max(F.struct("last_seen", "entity_id")).alias("m")).select("beginning", "m.entity_id")
    return asked.join(first, F.col("normal") == F.col("beginning")).select("name", "entity_id")


def contact_graph(members: DataFrame, contact, items: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, name, via, n): a contact's own items, those one hop away with the (least)
    contact they come by, and counts of projects of both and of the relations of whom
    the contact meets.

    ``items``: item_id, project; ``relations``: entity_id, relation."""
    own = members.filter(F.col("entity_id") == contact).select("item_id").distinct()
    met = members.filter(F.col("entity_id") != contact).join(own, "item_id", "left_semi")
    via = met.select(F.col("entity_id").alias("via")).distinct()
    hop = members.join(via, F.col("entity_id") == F.col("via")).groupBy("item_id").agg(F.min("via").alias("via")).join(own, "item_id", "left_anti")
    row = lambda rows, kind, name, via=F.lit(None).cast("long"), n=F.lit(1): rows.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), via.cast("long").alias("via"), n.cast("long").alias("n"))
    both = own.unionByName(hop.select("item_id")).join(items, "item_id").groupBy("project").agg(F.count("*").alias("n"))
    kinds = met.join(relations, "entity_id").groupBy("relation").agg(F.count("*").alias("n"))
    return (
        row(own, "direct", F.col("item_id"))
        .unionByName(row(hop, "hop", F.col("item_id"), F.col("via")))
        .unionByName(row(both, "project", F.col("project"), n=F.col("n")))
        .unionByName(row(kinds, "relation", F.col("relation"), n=F.col("n")))
    )


def phantom_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges that no item supports."""
    return edges.join(pairs(members).select("a", "b").distinct(), ["a", "b"], "left_anti")


def centroids(vectors: DataFrame, by: str = "project") -> DataFrame:
    """The element-wise mean of each group."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vectors.groupBy(by).agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("centroid"))


def episodes(items: DataFrame) -> DataFrame:
    """Key: mail thread, calendar day, project and week (from Sunday), or the item.

    ``items``: id, source, thread, day, project."""
    week = F.date_sub("day", F.dayofweek("day") - 1)
    key = (
        F.when(F.col("thread").isNotNull(), F.concat(F.lit("thread:"), F.col("thread")))
        .when(F.col("source") == "calendar", F.concat(F.lit("day:"), F.col("day").cast("string")))
        .when(F.col("project").isNotNull(), F.concat(F.lit("week:"), F.col("project"), F.lit(":"), week.cast("string")))
        .otherwise(F.concat(F.lit("item:"), F.col("id").cast("string")))
    )
    return items.withColumn("episode", key)


def kmeans(vectors: DataFrame, k: int, seed: int = 1, iterations: int = 20) -> DataFrame:
    """(id, cluster) of cosine k-means with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select("id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster").fit(ready)
    return model.transform(ready).select("id", "cluster")
