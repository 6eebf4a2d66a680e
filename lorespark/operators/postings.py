"""An inverted index: postings by term, kept as files, so that a search reads its terms.

``documents``: id, generation, the number of tokens and the columns that searches filter
by.  ``postings``: term, id, generation, how often the term stands in the whole text, and
for each field whether it stands there; in folders by the term's hash, sorted by term, so
that both the folder and the row groups of other terms are left out.  ``terms``: every
term once, for parts of words.

Documents that change are added again under a higher generation; older postings of them
no longer count and go with ``compact``.  A frequent term's folder is written by as many
tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import dealt, is_scratch, scratch
from .retrieval import FTS_B, FTS_K1, K1, B, recency, top

#: Folders of postings, and terms that a document is taken to have, for dealing documents to tasks.
BUCKETS, TERMS = 32, 250


def letters(text: Column) -> Column:
    """Terms of letters and digits, as full-text search takes them."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


class TermIndex:
    """``fields`` gives the names of the indexed columns, ``kept`` those of further columns
    that results are filtered and weighted by."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], kept: list[str], terms: Callable[[Column], Column] = words, buckets: int = BUCKETS):
        self.spark, self.path, self.fields, self.kept, self.terms, self.buckets = spark, path.rstrip("/"), fields, kept, terms, buckets
        self.generation = 0

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, items: DataFrame) -> TermIndex:
        """Index items (``id``, the fields, the kept columns); those there already are replaced."""
        self.generation = self._last() + 1
        new = F.lit(self.generation).alias("generation")
        present = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
        whole = self.terms(F.concat_ws(" ", *map(present, self.fields)))
        docs = items.select("id", new, F.size(whole).cast("long").alias("tokens"), *self.kept)
        docs.write.mode("append").parquet(f"{self.path}/documents")
        marked = lambda bit: lambda t: F.struct(t.alias("term"), F.lit(bit).alias("field"))
        each = F.flatten(F.array(*(F.transform(self.terms(present(f)), marked(1 << i)) for i, f in enumerate(self.fields))))
        spread = dealt(items.select("id", *self.fields), items.count() * TERMS, "id")  # a document's terms are counted where it is
        rows = spread.select("id", F.explode(each).alias("x")).select("id", "x.term", "x.field")
        found = rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.bit_or("field").alias("fields"))
        found = found.select(self.bucket(F.col("term")).alias("bucket"), "term", "id", new, "tf", "fields")
        sorted_ = found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
        sorted_.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        own = self._read("postings").filter(F.col("generation") == self.generation).select("term").distinct()
        if self.generation > 1:
            own = own.join(self._read("terms"), "term", "left_anti")
        own.select(self.bucket(F.col("term")).alias("bucket"), "term").write.mode("append").parquet(f"{self.path}/terms")
        return self

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _last(self) -> int:
        try:
            return self._read("documents").agg(F.max("generation")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return 0

    def documents(self) -> DataFrame:
        """The present generation of every document."""
        docs = self._read("documents")
        if self._last() < 2:
            return docs
        latest = docs.groupBy("id").agg(F.max("generation").alias("generation"))
        return docs.join(latest, ["id", "generation"])

    def postings(self, terms: list[str]) -> DataFrame:
        """Postings of whole terms: other folders aren't listed, other row groups not read."""
        places = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self.bucket(F.col("term"))).collect()
        return self._read("postings").filter(F.col("bucket").isin(sorted({b for (b,) in places})) & F.col("term").isin(terms))

    def postings_with(self, parts: list[str]) -> DataFrame:
        """Postings of all terms that hold one of the parts: the terms are looked up first,
        then the folders that have some."""
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.col("term").contains(p)
        return self._read("postings").join(self._read("terms").filter(hit), ["bucket", "term"], "left_semi")

    def frequencies(self, terms: list[str]) -> DataFrame:
        """``term, documents`` that hold it."""
        return self.postings(terms).join(self.documents().select("id", "generation"), ["id", "generation"], "left_semi").groupBy("term").agg(F.count("*").alias("documents"))

    def compact(self, path: str) -> TermIndex:
        """A new index without postings that no longer count."""
        new = TermIndex(self.spark, path, self.fields, self.kept, self.terms, self.buckets)
        live = self.documents().select("id", "generation")
        one = F.lit(1).alias("generation")
        self.documents().select("id", one, "tokens", *self.kept).write.parquet(f"{path}/documents")
        rows = self._read("postings").join(live, ["id", "generation"], "left_semi").select("bucket", "term", "id", one, "tf", "fields")
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
        new._read("postings").select("bucket", "term").distinct().write.parquet(f"{path}/terms")
        return new

    # Searches -------------------------------------------------------------

    def keyword_search(self, query: str, k: int, bonuses: dict[str, float], as_of: str | None = None, date: str | None = None, bias: float = 0.05, since: str | None = None) -> DataFrame:
        """Saturated frequencies of whole terms, and for each query term and field of
        ``bonuses`` in which it stands, even as part of a word, that much more; weighted by
        age where ``date`` names a kept column.  (id, score)."""
        given = query.lower().split()
        if not given:
            return self.documents().select("id", F.lit(0.0).alias("score")).limit(0)
        docs = self.documents()
        if since is not None:
            docs = docs.filter(F.col(date) >= F.lit(since).cast(docs.schema[date].dataType))
        average = docs.agg(F.avg("tokens").alias("_average"))
        distinct = sorted(set(given))
        sums = []
        for i, t in enumerate(distinct):
            sums.append(F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}"))
            sums.append(F.bit_or(F.when(F.col("term").contains(t), F.col("fields")).otherwise(0)).alias(f"in{i}"))
        found = self.postings_with(distinct).groupBy("id", "generation").agg(*sums)
        found = found.join(docs, ["id", "generation"]).crossJoin(F.broadcast(average))  # one row
        score = F.lit(0.0)
        for t in given:
            i = distinct.index(t)
            tf = F.col(f"tf{i}")
            score = score + tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("tokens") / F.col("_average")))
            for field, more in bonuses.items():
                score = score + F.when(F.col(f"in{i}").bitwiseAND(1 << self.fields.index(field)) != 0, more).otherwise(0.0)
        weight = recency(F.col(date), as_of, bias) if date and as_of else F.lit(1.0)
        return top(found.select("id", (score * weight).alias("score")).filter("score > 0"), k)

    def full_text_search(self, query: str, k: int) -> DataFrame:
        """Documents with all terms: inverse document frequency times saturation, with the
        kept columns.  (id, score, ...)."""
        terms = sorted(set(self._terms_of(query)))
        if not terms:
            return self.documents().select("id", F.lit(0.0).alias("score"), *self.kept).limit(0)
        docs = self.documents()
        stats = docs.agg(F.count("*").alias("_n"), F.avg("tokens").alias("_average"))
        known = {r.term: r.documents for r in self.frequencies(terms).collect()}  # a row for each query term
        found = self.postings(terms).join(docs, ["id", "generation"]).crossJoin(F.broadcast(stats))  # one row
        held = F.lit(0).cast("long")
        for t in terms:
            held = F.when(F.col("term") == t, known.get(t, 0)).otherwise(held)
        idf = F.greatest(F.log((F.col("_n") - held + 0.5) / (held + 0.5)), F.lit(1e-6))
        part = idf * F.col("tf") * (FTS_K1 + 1) / (F.col("tf") + FTS_K1 * (1 - FTS_B + FTS_B * F.col("tokens") / F.col("_average")))
        scored = found.groupBy("id", *self.kept).agg(F.sum(part).alias("score"), F.count("*").alias("_terms")).filter(F.col("_terms") == len(terms))
        return top(scored.select("id", "score", *self.kept), k)

    def full_text_strategy(self, query: str, k: int, keep: Column, as_of: str, date: str, bias: float = 0.05) -> DataFrame:
        """The best 3k of a full-text search that pass a filter, over the best of them,
        weighted by age."""
        found = self.full_text_search(query, 3 * k).filter(keep)
        best = found.agg(F.max("score").alias("_best"))
        return top(found.crossJoin(F.broadcast(best)).select("id", (F.col("score") / F.col("_best") * recency(F.col(date), as_of, bias)).alias("score")), k)  # one row

    def _terms_of(self, query: str) -> list[str]:
        return self.spark.range(1).select(self.terms(F.lit(query))).first()[0]


_BUILT: dict[tuple, TermIndex] = {}


def shared_index(spark: SparkSession, name: str, items: Callable[[], DataFrame], fields: list[str], kept: list[str], terms: Callable[[Column], Column] = words) -> TermIndex:
    """The session's index of that name, built when it is first asked for."""
    key = spark.sparkContext.applicationId, name
    if key not in _BUILT or not is_scratch(_BUILT[key].path):
        _BUILT[key] = TermIndex(spark, scratch(spark, "index"), fields, kept, terms).add(items())
    return _BUILT[key]
