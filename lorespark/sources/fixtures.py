"""Canonical tables derived from the provided Parquet tables.

``Tables`` gives them as DataFrames; ``CTES`` has the same derivations as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The "now" of queries over events, and of those over orders.
NOW, ORDERS_NOW = "2024-01-31 00:00:00", "2001-07-01 00:00:00"
#: The day that the derived dates of documents count back from.
TEXT_NOW = NOW


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def mentions(self) -> DataFrame:
        """One mention of a user in each event."""
        direction = F.when(F.col("event_type").isin("purchase", "signup"), "inbound").when(F.col("event_type").isin("click", "view"), "outbound")
        return self.read("events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("item_id"), F.col("event_type").alias("role"), direction.alias("direction"), F.col("ts").alias("mention_date"))

    def entities(self) -> DataFrame:
        who = self.read("events").select(F.col("user_id").alias("id")).distinct()
        label = F.when(F.col("id") % 5 == 0, "partner").when(F.col("id") % 5 == 1, "client").when(F.col("id") % 5 == 2, "vendor").when(F.col("id") % 5 == 3, "employee")
        return who.select("id", F.concat(F.lit("user_"), F.col("id").cast("string")).alias("name"), label.alias("label"), (F.col("id") % 17 == 0).alias("dismissed"))

    def knowledge(self) -> DataFrame:
        """One item for each event."""
        k = F.get_json_object("props", "$.k").cast("long")
        importance = F.when(F.col("value") >= 200, "critical").when(F.col("value") >= 80, "high").when(F.col("value") >= 10, "normal").otherwise("low")
        return self.read("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("project"), F.col("ts").alias("source_date"), importance.alias("importance"), "value", k.alias("k"), F.col("user_id").alias("entity_id"))

    def texts(self) -> DataFrame:
        """One item for each document."""
        labels = self.read("labels").select("doc_id", "quality", "toxic")
        importance = F.when(F.col("toxic") == 1, "noise").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("normal")
        day = F.date_sub(F.lit(TEXT_NOW[:10]).cast("date"), (F.col("doc_id") % 120).cast("int"))
        return self.read("documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.substring("text", 1, 200).alias("summary"), F.col("text").alias("raw_content"), F.col("lang").alias("project"), "source", importance.alias("importance"), day.alias("day"))

    def commitments(self) -> DataFrame:
        """One commitment for each order."""
        state = F.when(F.col("o_orderstatus") == "F", "fulfilled").when(F.col("o_orderstatus") == "O", "active").otherwise("detected")
        owners = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner"))
        return self.read("orders").join(owners, "o_custkey").select(F.col("o_orderkey").alias("id"), "owner", F.col("o_orderdate").alias("due_date"), state.alias("state"), F.col("o_orderpriority").alias("project"), F.col("o_totalprice").alias("amount"))

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("project"), "embedding")

    def members(self) -> DataFrame:
        """Suppliers that meet in an order."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("entity_id")).distinct()

    def meetings(self) -> DataFrame:
        """``members`` as the lines name them: one may stand twice, and counting reads no rows."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("entity_id"))

    def part_members(self) -> DataFrame:
        """Parts that meet in an order."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("entity_id")).distinct()

    def messages(self) -> DataFrame:
        return self.read("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "role", "text")


CTES = {
    "mentions": """SELECT user_id AS entity_id, event_id AS item_id, event_type AS role,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'inbound' WHEN event_type IN ('click', 'view') THEN 'outbound' END AS direction,
        ts AS mention_date FROM events""",
    "entities": """SELECT id, 'user_' || id AS name,
        CASE id % 5 WHEN 0 THEN 'partner' WHEN 1 THEN 'client' WHEN 2 THEN 'vendor' WHEN 3 THEN 'employee' END AS label,
        id % 17 = 0 AS dismissed FROM (SELECT DISTINCT user_id AS id FROM events)""",
    "knowledge": """SELECT event_id AS id, event_type AS source, 'p' || (json_extract_string(props, '$.k')::BIGINT % 7) AS project, ts AS source_date,
        CASE WHEN value >= 200 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 10 THEN 'normal' ELSE 'low' END AS importance,
        value, json_extract_string(props, '$.k')::BIGINT AS k, user_id AS entity_id FROM events""",
    "texts": f"""SELECT d.doc_id AS id, split_part(text, chr(10), 1) AS title, substring(text, 1, 200) AS summary, text AS raw_content, lang AS project, source,
        CASE WHEN toxic = 1 THEN 'noise' WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' ELSE 'normal' END AS importance,
        (DATE '{TEXT_NOW[:10]}' - (d.doc_id % 120)::INTEGER)::DATE AS day FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "commitments": """SELECT o_orderkey AS id, c_name AS owner, o_orderdate AS due_date,
        CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'active' ELSE 'detected' END AS state,
        o_orderpriority AS project, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey""",
    "vectors": "SELECT vec_id AS id, label AS project, embedding::DOUBLE[] AS embedding FROM embeddings",
    "members": "SELECT DISTINCT l_orderkey AS item_id, l_suppkey AS entity_id FROM lineitem",
    "part_members": "SELECT DISTINCT l_orderkey AS item_id, l_partkey AS entity_id FROM lineitem",
    "messages": "SELECT conv_id AS session_id, turn AS position, role, text FROM conversations",
}


def with_tables(body: str) -> str:
    """The SQL with a CTE before it for each canonical table that it names."""
    import re

    used = [f"{k} AS ({v})" for k, v in CTES.items() if re.search(rf"\b(?:FROM|JOIN)\s+{k}\b", body) and not re.search(rf"(?:WITH|,)\s+{k} AS \(", body)]
    own = body.strip()
    if not used:
        return own
    if own.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(used) + ",\n" + own[15:]
    return "WITH " + ",\n".join(used) + (",\n" + own[5:] if own.upper().startswith("WITH ") else "\n" + own)
