"""Pairs of sets that overlap enough, without pairing all that share something common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(sets: DataFrame, prefix: Callable[[Column], Column]) -> DataFrame:
    """(key, id, items, id_b, items_b), id < id_b: sets (``id, key, items``) of one key that
    share one of their first items, each pair once.

    A key's items have one order, rarest first.  Of two sets with at least ``o`` common
    items, the first n - o + 1 of each share one; so ``prefix`` of a set's size names how
    many suffice, and an item that is in most sets is rarely among them."""
    each = sets.select("id", "key", F.explode(F.array_distinct("items")).alias("item"))
    uses = each.groupBy("key", "item").agg(F.count("*").alias("n"))
    ranked = each.join(uses, ["key", "item"]).groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("r"))
    ranked = ranked.select("key", "id", F.transform("r", lambda x: x["item"]).alias("items"))
    first = F.slice("items", 1, F.greatest(F.lit(0), prefix(F.size("items")).cast("int")))
    a = ranked.select("key", "id", "items", first.alias("first")).withColumn("by", F.explode("first"))
    b = a.select("key", "by", F.col("id").alias("id_b"), F.col("items").alias("items_b"), F.col("first").alias("first_b"))
    met = a.join(b, ["key", "by"]).filter("id < id_b").filter(F.element_at(F.array_intersect("first", "first_b"), 1) == F.col("by"))
    return met.select("key", "id", "items", "id_b", "items_b")


#: Letters by which names are looked up in texts.
GRAM = 3


def _grams(text: str, sizes: list[int]) -> Column:
    text = F.lower(text)
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def names_in_texts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name_id, text_id): which texts hold which names, in any case.

    A name is looked up by its three letters that stand in the fewest texts, so a beginning
    that all names share pairs nothing; what meets is compared in full.  A name of one or
    two letters is looked up by itself; an empty one is in every text and is left out."""
    own = names.filter(F.length("name") > 0)
    sizes = sorted(r[0] for r in own.select(F.least(F.length("name"), F.lit(GRAM)).alias("n")).distinct().collect()) or [GRAM]  # at most three rows
    placed = texts.select("text_id", "text", F.explode(_grams("text", sizes)).alias("gram"))
    uses = placed.groupBy("gram").agg(F.count("*").alias("uses"))
    wanted = own.select("name_id", "name", F.explode(_grams("name", [GRAM])).alias("gram"))
    if sizes[0] < GRAM:
        wanted = wanted.unionByName(own.filter(F.length("name") < GRAM).select("name_id", "name", F.lower("name").alias("gram")))
    rarest = wanted.join(uses, "gram").groupBy("name_id", "name").agg(F.min(F.struct("uses", "gram")).alias("best"), F.count("*").alias("found"))
    all_ = wanted.groupBy("name_id", "name").agg(F.count("*").alias("n"))
    rarest = rarest.join(all_, ["name_id", "name"]).filter("found = n").select("name_id", "name", F.col("best.gram").alias("gram"))  # a gram in no text: no text has the name
    return rarest.join(placed, "gram").filter(F.lower("text").contains(F.lower("name"))).select("name_id", "text_id").distinct()
