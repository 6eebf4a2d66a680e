"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct ``NGRAM``-word shingles (as 56-bit
hashes).  All shingles have one order, rarest first.  Of two sets of at least
``t`` common shingles, the first ``n - t + l`` of each share at least ``l``: so
a document may lengthen its prefix by one shingle for each further match that it
asks for, and a pair need be looked at only if it shares as many prefix shingles
as the less demanding of the two asks.  Each document takes the ``l`` of least
estimated cost (entries to read, plus candidates to verify, from the frequencies
in its prefix).

Steps.
1. The distinct shingles of a batch of documents travel, packed, to ranges of
   hashes, each once however many of the batch's documents have it; a range finds
   those that more than one document of the corpus has and sends their frequencies
   back.  Which document has which shingle stays with the batch.  A document whose shingles are mostly its own
   can't reach the threshold and is done.
2. Equal sets become one class.  Each class goes to a hub, the leader (least
   hashed member) of most of its prefix shingles' lists, and is compared with it:
   in a group of near copies nearly all hang on one hub after this.
3. Classes that hang on one hub need no comparison among themselves.  What is
   left (the balls of the hubs against the others, and the others among
   themselves) is dealt as pairs of blocks of bounded size for which prefix
   shingles coincide; a pair of blocks counts prefix matches, verifies
   candidates exactly, and returns a spanning forest of its links.
4. Components of all links.

No list of pairs is ever made of a group.  The comparisons of step 3 are
quadratic only in those members of a group of similar documents that are not
similar enough to hang together.

Defined results: a text without words (or null) has no shingles, is linked with
nothing and is its own component; fewer than ``NGRAM`` words are one shingle; a
null doc_id is carried and gives no name to a component (which is null if all
its ids are); repeated rows each give a row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import forget, lower_ascii, materialize, mix, partitions, prefix_hash, prepare, ragged, settled, slices, span_hash, table, utf8, window_hash, word_spans
from .graph import components
from .packed import MOVE, ascending, bits, by_group, frame, how_many_ranges, in_parts, moves, own_range, planes, range_cuts, unascending, unbits, unframe, unplanes

NGRAM = 5
#: The threshold: PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Bytes of text in a batch whose shingles travel together.
BATCH_BYTES = 1 << 23
#: Shingles in a block of classes that are compared together.
BLOCK_SHINGLES = 400_000
#: The most matches that a prefix asks for.
MOST_MATCHES = 64


def shingles(data: np.ndarray, offs: np.ndarray, ngram: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (56 bits) of each text; A-Z count as a-z."""
    data = lower_ascii(data)
    starts, ends, doc = word_spans(data, offs)
    words = span_hash(prefix_hash(data), starts, ends)
    runs = window_hash(words, ngram) >> np.uint64(8)
    bounds = np.searchsorted(doc, np.arange(len(offs)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= ngram:
            out.append(np.unique(runs[a : b - ngram + 1]))
        elif b > a:
            out.append(mix(window_hash(words[a:b], b - a) ^ np.uint64(b - a)) >> np.uint64(8))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _deal(ranges: int, ngram: int, id_type: pa.DataType):
    """The distinct shingles of batches of documents by hash range, each once with the
    number of the batch's documents that have it; and a row with these documents' ids
    and prints, and which of them have each shingle."""
    names = pa.schema([("doc_id", id_type)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        sets: list[np.ndarray] = []
        size = 0

        def rows() -> list[tuple]:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, names) as out:
                out.write_table(pa.table([pa.chunked_array(ids)], names=["doc_id"]))
            prints = b"".join(hashlib.md5(s.tobytes()).digest() for s in sets)
            lengths = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, doc = flat[order], np.repeat(np.arange(len(sets)), lengths)[order]
            begins = np.flatnonzero(np.diff(flat, prepend=flat[:1] + np.uint64(1)))
            each, uses = flat[begins], np.diff(np.append(begins, len(flat)))
            out = [(number, own_range(number, ranges), frame(sink.getvalue().to_pybytes(), prints, planes(lengths), planes(uses), planes(doc)))]
            return out + [(number, r, frame(ascending(each[a:b]), planes(uses[a:b]))) for r, a, b in range_cuts(each, 56, ranges)]

        for batch in batches:
            data, offs = utf8(batch.column(1))
            for i, j in slices(offs):
                ids.append(batch.column(0).slice(i, j - i))
                sets += shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ngram)
                size += int(offs[j] - offs[i])
                if size >= BATCH_BYTES or len(sets) >= 60_000:
                    yield moves(rows())
                    number += 1
                    size = 0
                    ids.clear(), sets.clear()
        if sets:
            yield moves(rows())

    return work


def _count(ranges: int):
    """Of each range, which shingles more than one document of the corpus has, and how
    many have these, back to each batch."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for place, parts in in_parts(rows, 56, ranges, lambda p: (lambda t, n: (unascending(t), unplanes(n)))(*unframe(p))):
            flat, uses = np.concatenate([t for t, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(flat, kind="stable")
            begins = np.flatnonzero(np.diff(flat[order], prepend=flat[order[:1]] + np.uint64(1)))
            totals = np.empty(len(flat), np.uint64)
            totals[order] = np.repeat(np.add.reduceat(uses[order], begins), np.diff(np.append(begins, len(flat)))) if len(flat) else 0
            at = 0
            for (number, *_), (tokens, _) in zip(rows, parts, strict=True):
                own = totals[at : at + len(tokens)]
                at += len(tokens)
                left = own > 1
                yield moves([(number, place, frame(len(tokens).to_bytes(8, "little"), bits(left), ascending(tokens[left]), planes(own[left])))])

    return lambda batches: by_group(batches, 1, solve)


def matches_asked(uses: np.ndarray, n: int, t: int) -> int:
    """The ``l`` of least cost for a set of ``n`` shingles of which those with
    ``uses`` (ascending) are shared, if ``t`` must coincide: the entries of the
    prefix's lists are read, and at most entries / l candidates verified, each
    at the price of a set."""
    spare = len(uses) - t
    most = min(t, MOST_MATCHES)
    asked = np.arange(1, most + 1)
    entries = np.cumsum(uses)[spare + asked - 1].astype(np.float64)
    return int(np.argmin(entries * (1 + n / asked))) + 1


def _gather(id_type: pa.DataType):
    """The sets of each batch: all documents, and for those that may have a
    partner the shared shingles in the common order."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        (*_, head), *rest = rows
        ids, prints, lengths, runs, docs = unframe(head)
        ids = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
        lengths, runs, docs = (unplanes(x).astype(np.int64) for x in (lengths, runs, docs))
        parts = [unframe(p) for *_, p in rest]
        none = np.zeros(0, np.uint64)
        left = np.concatenate([none.astype(bool), *(unbits(b, int.from_bytes(n, "little")) for n, b, *_ in parts)])
        docs, runs = docs[np.repeat(left, runs)], runs[left]
        tokens = np.repeat(np.concatenate([none, *(unascending(t) for *_, t, _ in parts)]), runs)
        uses = np.repeat(np.concatenate([none, *(unplanes(u) for *_, u in parts)]), runs).astype(np.int64)
        order = np.lexsort((tokens, uses, docs))
        tokens, docs, uses = tokens[order].view(np.int64), docs[order], uses[order]
        bounds = np.searchsorted(docs, np.arange(len(lengths) + 1))
        asked, prefix, kept = [], [], []
        for n, a, b in zip(lengths.tolist(), bounds[:-1], bounds[1:], strict=True):
            t = -(-PERCENT * n // 100)
            if n and b - a >= t:
                asked.append(matches_asked(uses[a:b], n, t))
                prefix.append(b - a - t + asked[-1])
                kept.append(tokens[a:b])
            else:
                asked.append(None), prefix.append(None), kept.append(None)
        fp = [prints[i : i + 16] for i in range(0, len(prints), 16)]
        columns = [ids, pa.array(lengths, pa.int64()), pa.array(fp, pa.binary()), pa.array(asked, pa.int32()), pa.array(prefix, pa.int32()), pa.array(kept, pa.list_(pa.int64()))]
        whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "fp", "asked", "prefix", "shared"])
        yield from (whole.slice(i, 512) for i in range(0, len(whole), 512))

    return lambda batches: by_group(batches, 0, solve)


def shingle_sets(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``doc_id, n, fp`` of every row, and ``asked, prefix, shared`` of those
    that may have a partner."""
    spark = prepare(docs.sparkSession)
    rows = settled(docs.select("doc_id", "text"), "settled")  # batches are numbered by their order in a task
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = how_many_ranges(size, partitions(spark))
    dealt = rows.mapInArrow(_deal(ranges, ngram, id_type), MOVE)
    counted = dealt.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_count(ranges), MOVE)
    ordered = counted.repartition(ranges, "batch").sortWithinPartitions("batch", "range")
    return ordered.mapInArrow(_gather(id_type), f"doc_id {kind.simpleString()}, n long, fp binary, asked int, prefix int, shared array<long>")


def _similar(common: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (n + m - common)


class _Index:
    """Counts common entries of a list with each of many lists."""

    def __init__(self, lists: list[np.ndarray]) -> None:
        flat = np.concatenate(lists)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]
        self.n = len(lists)

    def common(self, own: np.ndarray) -> np.ndarray:
        a = np.searchsorted(self.flat, own, "left")
        b = np.searchsorted(self.flat, own, "right")
        return np.bincount(ragged(self.owner, a, b - a), minlength=self.n)


def block_links(left: list[dict], right: list[dict] | None) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks, or within one.  What
    hangs on one hub (``ball``) is linked already."""
    rows = left if right is None else left + right
    group: dict = {}
    comp = np.array([group.setdefault((r["hub"] if r["ball"] else r["fp"]), len(group)) for r in rows])
    first = 0 if right is None else len(left)
    others = rows[first:]
    asked, size = np.array([r["asked"] for r in others]), np.array([r["n"] for r in others])
    prefixes = _Index([r["shared"][: r["prefix"]] for r in others])
    whole = None
    links = []
    for i, row in enumerate(left):
        counts = prefixes.common(row["shared"][: row["prefix"]])
        likely = (counts >= np.minimum(asked, row["asked"])) & (comp[first:] != comp[i])
        if right is None:
            likely[: i + 1] = False
        if not likely.any():
            continue
        if likely.sum() <= 4:
            common = np.zeros(len(others), np.int64)
            for j in np.flatnonzero(likely):
                common[j] = len(np.intersect1d(row["shared"], others[j]["shared"], assume_unique=True))
        else:
            whole = whole or _Index([r["shared"] for r in others])
            common = whole.common(row["shared"])
        for j in np.flatnonzero(likely & _similar(common, row["n"], size)):
            if comp[first + j] != comp[i]:
                links.append((row["fp"], others[j]["fp"]))
                comp[comp == comp[first + j]] = comp[i]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(rows: list[dict]) -> list[tuple[int, int]]:
        left, right = [r for r in rows if not r["side"]], [r for r in rows if r["side"]]
        return block_links(left, right or None) if len(rows) > 1 else []

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    last, rows, links = None, [], []
    for batch in batches:
        columns = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names) if k != "shared"}
        shared = batch.column(batch.schema.get_field_index("shared"))
        flat, offs = shared.values.to_numpy(), shared.offsets.to_numpy()
        for i in range(len(batch)):
            row = {k: v[i] for k, v in columns.items()} | {"shared": flat[offs[i] : offs[i + 1]]}
            if row["pair"] != last and rows:
                links += solve(rows)
                rows = []
            last = row["pair"]
            rows.append(row)
        yield out(links)
        links = []
    if rows:
        yield out(solve(rows))


def class_links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (``a, b``) between classes of equal sets that have the same
    components as all links, and the classes' numbers (``fp, node``): they are
    numbered as they are written, so that lists and links hold 8 bytes for each."""
    spark = sets.sparkSession
    classes = sets.filter("shared is not null").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "asked", "prefix", "shared")))
    classes = materialize(classes.withColumnRenamed("fp", "print").withColumn("fp", F.monotonically_increasing_id()), "classes")
    numbers = materialize(classes.select(F.col("print").alias("fp"), F.col("fp").alias("node")), "numbers")
    lists = classes.select("fp", F.explode(F.slice("shared", 1, F.col("prefix"))).alias("token"))
    leaders = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("fp").alias("h"), F.col("fp").alias("leader"))).alias("lead"), F.count("*").alias("c")).filter("c > 1")
    led = materialize(lists.join(leaders.select("token", "lead.leader"), "token"), "lists")
    hubs = led.groupBy("fp", "leader").count().groupBy("fp").agg(F.max(F.struct("count", "leader")).alias("best")).select("fp", F.col("best.leader").alias("hub"))
    hub_sets = classes.select(F.col("fp").alias("hub"), F.col("n").alias("hub_n"), F.col("asked").alias("hub_asked"), F.col("prefix").alias("hub_prefix"), F.col("shared").alias("hub_shared"))
    common = F.size(F.array_intersect("shared", "hub_shared"))
    enough = F.size(F.array_intersect(F.slice("shared", 1, F.col("prefix")), F.slice("hub_shared", 1, F.col("hub_prefix")))) >= F.least("asked", "hub_asked")
    linked = F.when(enough, 100 * common >= PERCENT * (F.col("n") + F.col("hub_n") - common)).otherwise(False)
    placed = classes.join(hubs, "fp").join(hub_sets, "hub").select("fp", "hub", "asked", F.size("shared").alias("size"), ((F.col("fp") == F.col("hub")) | linked).alias("ball"))
    placed = materialize(placed, "placed")

    groups = placed.groupBy("hub", "ball").agg(F.count("*").alias("members"), F.min("asked").alias("asked"), F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    groups = materialize(groups, "groups")
    # groups of different hubs that share enough prefix shingles
    held = led.select("fp", "token").join(placed.select("fp", "hub", "ball"), "fp").select("token", "hub", "ball").distinct()
    other = held.select("token", F.col("hub").alias("hub2"), F.col("ball").alias("ball2"))
    shared = held.join(other, "token").filter("hub < hub2").groupBy("hub", "ball", "hub2", "ball2").count()
    side = lambda n: groups.select(F.col("hub").alias(f"hub{n}"), F.col("ball").alias(f"ball{n}"), F.col("asked").alias(f"asked{n}"), F.col("blocks").alias(f"blocks{n}"))
    across = shared.join(side(""), ["hub", "ball"]).join(side(2), ["hub2", "ball2"]).filter(F.col("count") >= F.least("asked", "asked2")).select("hub", "ball", "blocks", "hub2", "ball2", "blocks2")
    # a hub's loose members against its ball and among themselves
    loose = groups.filter(~F.col("ball")).select("hub", "ball", "blocks", "members")
    balls = groups.filter("ball").select("hub", F.col("ball").alias("ball2"), F.col("blocks").alias("blocks2"))
    inner = loose.join(balls, "hub").select("hub", "ball", "blocks", F.col("hub").alias("hub2"), "ball2", "blocks2")
    among = loose.filter("members > 1").select("hub", "ball", "blocks", F.col("hub").alias("hub2"), F.col("ball").alias("ball2"), F.col("blocks").alias("blocks2"))
    pairs = across.unionByName(inner).unionByName(among)
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pairs = pairs.withColumn("block", F.explode(upto("blocks"))).withColumn("block2", F.explode(upto("blocks2")))
    same = (F.col("hub") == F.col("hub2")) & (F.col("ball") == F.col("ball2"))
    pairs = pairs.filter(~same | (F.col("block") <= F.col("block2")))
    pairs = pairs.withColumn("pair", F.concat_ws(":", F.col("hub").cast("string"), "ball", "block", F.col("hub2").cast("string"), "ball2", "block2"))
    one = F.struct(F.col("hub"), F.col("ball"), F.col("block"), F.lit(0).alias("side"))
    two = F.struct(F.col("hub2").alias("hub"), F.col("ball2").alias("ball"), F.col("block2").alias("block"), F.lit(1).alias("side"))
    wanted = pairs.select("pair", F.explode(F.when(same & (F.col("block") == F.col("block2")), F.array(one)).otherwise(F.array(one, two))).alias("x")).select("pair", "x.*")
    members = placed.select("fp", "hub", "ball").join(groups.select("hub", "ball", "blocks"), ["hub", "ball"])
    members = members.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).drop("blocks")
    sent = wanted.join(members, ["hub", "ball", "block"]).join(classes, "fp").select("pair", "side", "fp", "hub", "ball", "n", "asked", "prefix", "shared")
    links = sent.repartition(partitions(spark), "pair").sortWithinPartitions("pair", "side").mapInArrow(_compare, "a long, b long")
    links = links.unionByName(placed.filter("ball").select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    links = materialize(links.distinct(), "links")
    for done in (classes, led, placed, groups):
        forget(done)
    return links, numbers


def labelled_sets(docs: DataFrame, ngram: int = NGRAM) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents (see ``shingle_sets``), and for each class of
    equal sets its component's name and smallest id (``fp, component,
    component_id``)."""
    sets = materialize(shingle_sets(docs, ngram), "sets")
    links, numbers = class_links(sets)
    parts = numbers.join(components(links), "node").select("fp", "component")
    names = sets.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = names.join(parts, "fp", "left").withColumn("component", F.coalesce(F.col("component").cast("string"), F.hex("fp")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return sets, named.select("fp", "component").join(least, "component").select("fp", "component", "component_id")


def jaccard_components(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    sets, label = labelled_sets(docs, ngram)
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "fp")
    linked = rows.filter("n_shingles > 0").join(label, "fp").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def jaccard_representatives(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest id (null ids come
    last), of such rows the one of the least MD5 of the text, and of wholly
    repeated rows any one.  Rows without words are linked with nothing: all stay.
    """
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    name = lambda k: F.concat_ws("|", F.coalesce(k["id"].cast("string"), F.lit("none")), k["md5"])
    _, label = labelled_sets(docs.filter(~blank).select(key.alias("doc_id"), "text"), ngram)
    keep = label.select(name(F.col("component_id")).alias("_keep")).distinct()
    words = docs.filter(~blank).withColumn("_name", name(key))
    chosen = words.join(keep, F.col("_name") == F.col("_keep"), "left_semi").dropDuplicates(["_name"]).drop("_name")
    return chosen.unionByName(docs.filter(blank))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: The same by all pairs of sets that share a shingle, and their closure.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT e.b, r.root FROM reach r JOIN both_ e ON e.a = r.d)
SELECT doc_id, len(s) AS n_shingles, min(root) AS component_id FROM sets JOIN reach ON d = doc_id GROUP BY ALL
"""
