"""Readers of files, transcripts, mail threads and session logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import frontmatter

# Extensions of text files that are read.
EXTENSIONS = ["md", "txt", "json", "csv", "html", "yaml", "yml", "xml", "log", "rst", "org", "tex", "rtf", "toml"]


def text_files(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """Text files below a folder, dot folders and packages aside: path, name,
    extension, modified, content, the front matter as a map."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substring_index("path", re.sub(r"^\w+:/*", "/", path).rstrip("/"), -1)  # what the folder itself is called doesn't matter
    return _texts(files.select("path", F.col("modificationTime").alias("modified"), "content"), below, least)


def archived_text_files(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """``text_files`` of a folder that ``write_archives`` has packed."""
    return _texts(archived_files(spark, path), F.col("path"), least)


def _texts(files: DataFrame, below: F.Column, least: int) -> DataFrame:
    """What is kept of files (``path, modified, content``); ``below`` is the path from the folder on."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    own = files.select("path", name.alias("name"), extension.alias("extension"), "modified", F.col("content").cast("string").alias("content"))
    own = own.filter(F.col("extension").isin(EXTENSIONS) & ~below.rlike(r"/\.[^/]|/node_modules/") & (F.length("content") >= least))
    return own.withColumn("meta", frontmatter(F.col("content")))


#: Bytes of files up to which they go into one archive.
ARCHIVE = 1 << 18


def write_archives(files: DataFrame, path: str, most: int = ARCHIVE) -> None:
    """Files (``path`` below the folder, ``content``) as tar archives of about ``most`` bytes,
    each a binary value of a Parquet row: a folder of many small files takes neither a file
    nor a commit for each.  Rows of one path that follow each other are one file's lines; a
    file that the archive can't hold goes on in the next under the same name."""
    import io
    import tarfile
    import time

    import pyarrow as pa

    def whole(members: list[tuple[str, list[bytes]]]) -> pa.RecordBatch:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, parts in members:
                content = b"".join(parts)
                info = tarfile.TarInfo(name)
                info.size, info.mtime = len(content), int(time.time())
                tar.addfile(info, io.BytesIO(content))
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["archive"])

    def work(batches):
        members: list[tuple[str, list[bytes]]] = []
        size = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if members and members[-1][0] == name:
                    members[-1][1].append(content.as_py() or b"")
                else:
                    members.append((name, [content.as_py() or b""]))
                    size += 1_024  # a header and what fills up the last block
                size += len(members[-1][1][-1])
                if size >= most:
                    yield whole(members)
                    members, size = [], 0
        if members:
            yield whole(members)

    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(work, "archive binary").write.option("compression", "none").option("parquet.block.size", 1 << 25).parquet(path)


def archived_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder that ``write_archives`` has packed: path (from the folder on,
    with a slash before it), modified, content."""
    import io
    import tarfile

    import pyarrow as pa

    kinds = {"path": pa.string(), "modified": pa.timestamp("us", "UTC"), "content": pa.binary()}

    def work(batches):
        for batch in batches:
            for blob in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(blob.as_py())) as tar:
                    held = [("/" + m.name, int(m.mtime) * 1_000_000, tar.extractfile(m).read()) for m in tar if m.isfile()]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    return spark.read.schema("archive binary").parquet(path).mapInArrow(work, "path string, modified timestamp, content binary")


def latest_outputs(files: DataFrame) -> DataFrame:
    """Of versioned outputs (name_v2.md) the highest version, then the newest; with
    a reference of 16 hex digits from the path."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    version = F.coalesce(F.regexp_extract(stem, r"[-_]?v(\d+)$", 1).try_cast("int"), F.lit(0))
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    own = files.withColumn("stem", F.regexp_replace(stem, r"[-_]?v\d+$", "")).withColumn("version", version).withColumn("folder", folder)
    rank = F.row_number().over(Window.partitionBy("folder", "stem").orderBy(F.desc("version"), F.desc("modified"), "path"))
    return own.withColumn("_rank", rank).filter("_rank = 1").drop("_rank").withColumn("ref", F.substring(F.sha2("path", 256), 1, 16))


def speaker_blocks(sentences: DataFrame, most: int = 12_000) -> DataFrame:
    """One text a transcript: consecutive sentences of a speaker as one block.

    ``sentences``: transcript_id, position, speaker, text."""
    order = Window.partitionBy("transcript_id").orderBy("position")
    begins = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = sentences.withColumn("begin", begins).withColumn("block", F.sum("begin").over(order))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c]), " ")
    blocks = marked.groupBy("transcript_id", "block").agg(F.first("speaker").alias("speaker"), F.min("position").alias("position"), joined("text").alias("text"))
    line = F.concat(F.lit("["), F.coalesce("speaker", F.lit("unknown")), F.lit("] "), F.col("text"))
    own = blocks.withColumn("line", line).groupBy("transcript_id").agg(F.count("*").alias("blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return own.withColumn("text", F.substring("text", 1, most))


def mail_threads(mails: DataFrame) -> DataFrame:
    """One row a thread: first and last senders, subject of the first, size.

    ``mails``: thread_id, at, sender, subject, body."""
    first, last = F.min(F.struct("at", "sender", "subject")), F.max(F.struct("at", "sender"))
    return mails.groupBy("thread_id").agg(first.alias("f"), last.alias("l"), F.count("*").alias("messages")).select("thread_id", "messages", F.col("f.sender").alias("first_sender"), F.col("l.sender").alias("last_sender"), F.col("f.subject").alias("subject"), F.col("l.at").alias("last_at"))


def calendar_events(events: DataFrame, most: int = 5) -> DataFrame:
    """Events without series that recur more than ``most`` times in the window, and
    without generic whole-day titles."""
    n = F.count("*").over(Window.partitionBy("recurring_id"))
    own = events.withColumn("_n", F.when(F.col("recurring_id").isNull(), 1).otherwise(n)).filter(F.col("_n") <= most).drop("_n")
    return own.filter(~(F.col("all_day") & F.lower("title").rlike(r"^(home|office|out of office|busy|focus time|working from home|wfh)$")))


def session_logs(spark: SparkSession, path: str, tool_chars: int = 3_000, session: str = r"([^/]+)\.jsonl$") -> DataFrame:
    """Agent sessions from JSON lines: session, position, role, text.  Content is
    text, or a list of parts of which text is kept and tool output shortened.
    ``session`` finds the session's name in a file's path; sessions whose names
    begin with agent- or task- are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=False).withColumn("file", F.input_file_name())
    return _session_lines(raw, tool_chars, session)


def archived_session_logs(spark: SparkSession, path: str, tool_chars: int = 3_000, session: str = r"([^/]+)\.jsonl$") -> DataFrame:
    """``session_logs`` of a folder that ``write_archives`` has packed."""
    files = archived_files(spark, path)
    lines = files.select(F.col("path").alias("file"), F.explode(F.split(F.col("content").cast("string"), "\r\n|\r|\n")).alias("value"))
    return _session_lines(lines, tool_chars, session)


def _session_lines(raw: DataFrame, tool_chars: int, session: str) -> DataFrame:
    """What is kept of lines (``file, value``)."""
    raw = raw.withColumn("session", F.regexp_extract("file", session, 1)).filter(~F.col("session").rlike("^(agent|task)-"))
    v = F.try_parse_json("value")
    parts = F.from_json(F.get_json_object("value", "$.message.content"), "array<struct<type: string, text: string, content: string>>")
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin("text", "tool_result")), lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.substring(p["content"], 1, tool_chars))), "\n")
    role = F.get_json_object("value", "$.message.role")
    out = raw.filter(v.isNotNull()).select(F.col("session").alias("session_id"), F.get_json_object("value", "$.timestamp").alias("at"), role.alias("role"), F.coalesce(text, F.get_json_object("value", "$.message.content")).alias("text"))
    return out.filter(F.col("role").isin("user", "assistant") & (F.col("text") != ""))


def outline(rows: DataFrame, depth: int = 8) -> DataFrame:
    """Depth-first order of an outline (``id, parent_id, position, text``) as a path."""
    level = rows.filter("parent_id is null").select("id", "text", F.lpad(F.col("position").cast("string"), 6, "0").alias("path"), F.lit(0).alias("level"))
    out = level
    for _ in range(depth):
        up = level.select(F.col("id").alias("parent_id"), F.col("path").alias("above"), "level")
        level = rows.join(up, "parent_id").select("id", "text", F.concat_ws("/", "above", F.lpad(F.col("position").cast("string"), 6, "0")).alias("path"), (F.col("level") + 1).alias("level"))
        out = out.unionByName(level)
    return out


def decode_array(column: str) -> F.Column:
    """A JSON array of strings; what doesn't parse is one element."""
    return F.coalesce(F.from_json(column, "array<string>"), F.when(F.col(column).isNotNull(), F.array(column)))


def incremental(rows: DataFrame, column: str, mark) -> DataFrame:
    """Rows after a high-water mark (all without one)."""
    return rows if mark is None else rows.filter(F.col(column) > F.lit(mark))


def encode_vectors(rows: DataFrame, column: str, name: str = "blob") -> DataFrame:
    """Vectors as little-endian float32 bytes; null stays null."""
    import numpy as np
    import pyarrow as pa

    kept = [c for c in rows.columns if c != column]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)

    def work(batches):
        for batch in batches:
            blobs = [None if v is None else np.array(v, "<f4").tobytes() for v in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(blobs, pa.binary())], [*kept, name])

    return rows.select(*kept, column).mapInArrow(work, f"{types}, {name} binary")


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of exported chats (a JSON row a conversation with its messages), and
    the bodies of the artifacts that they hold: chat_id, position, sender, text,
    artifacts."""
    schema = "uuid string, name string, chat_messages array<struct<sender: string, text: string>>"
    rows = spark.read.schema(schema).json(path)
    each = rows.select(F.col("uuid").alias("chat_id"), F.posexplode("chat_messages").alias("position", "m"))
    bodies = F.regexp_extract_all("m.text", F.lit(r"(?s)<antArtifact\b[^>]*>(.*?)</antArtifact>"), F.lit(1))
    return each.select("chat_id", "position", F.col("m.sender").alias("sender"), F.col("m.text").alias("text"), bodies.alias("artifacts"))


def transcript_importance(meetings: DataFrame, minutes: int = 30) -> DataFrame:
    """Meetings (``id, minutes, speakers``): longer ones with several speakers are high."""
    return meetings.withColumn("importance", F.when((F.col("minutes") > minutes) & (F.col("speakers") > 1), "high").otherwise("normal"))


def drive_files(files: DataFrame, as_of, days: int, most: int = 10_000) -> DataFrame:
    """Files modified lately (``id, owner, modifier, modified, text``) with their text
    export, which is cut at ``most`` characters."""
    from ..functions.time import since

    return files.filter(since("modified", as_of, days)).select("id", "owner", "modifier", "modified", F.substring("text", 1, most).alias("text"))


def remember(items: DataFrame, text: str, at) -> DataFrame:
    """The items (``id, source, text, at``) and one captured by hand, named by its text."""
    spark = items.sparkSession
    one = spark.range(1).select(F.concat(F.lit("manual:"), F.md5(F.lit(text).cast("binary"))).alias("id"), F.lit("manual").alias("source"), F.lit(text).alias("text"), F.lit(at).cast("timestamp_ntz").alias("at"))
    return items.unionByName(one)


def decode_vectors(rows: DataFrame, column: str, name: str = "embedding") -> DataFrame:
    """Vectors stored as little-endian float32 bytes, as arrays; what isn't whole
    numbers of floats, or null, gives null.  Arrow batches, one numpy view each."""
    import numpy as np
    import pyarrow as pa

    kept = [c for c in rows.columns if c != column]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)

    def work(batches):
        for batch in batches:
            blobs = batch.column(len(kept)).to_pylist()
            vectors = [np.frombuffer(b, "<f4") if b and len(b) % 4 == 0 else None for b in blobs]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(vectors, pa.list_(pa.float32()))], [*kept, name])

    return rows.select(*kept, column).mapInArrow(work, f"{types}, {name} array<float>")


def recipients(header: str) -> F.Column:
    """The addresses of a mail header, lower-cased, each once."""
    found = F.regexp_extract_all(F.lower(header), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0))
    return F.array_distinct(found)


def sent_mails(mails: DataFrame, me: str) -> DataFrame:
    """Threads (``thread_id, at, sender, to``) with whom I wrote to, and who wrote
    first and last."""
    mine = F.lower("sender").contains(me.lower())
    own = mails.groupBy("thread_id").agg(F.min_by(mine, "at").alias("i_began"), F.max_by(mine, "at").alias("i_answered_last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(mine, recipients("to")))))).alias("wrote_to"))
    return own.filter(F.size("wrote_to") > 0)


def table_after(spark: SparkSession, url: str, table: str, column: str, mark: int, **options: str) -> DataFrame:
    """Rows of a JDBC table after a mark; the predicate goes to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().filter(F.col(column) > mark)


def write_databases(rows: DataFrame, path: str, table: str, most: int = 2_000) -> None:
    """Rows (of numbers and texts) as SQLite databases with a table of at most ``most`` rows
    each, every database a binary value of a Parquet row: any executor can read it."""
    import sqlite3

    import pyarrow as pa

    names = rows.columns
    marks, columns = ", ".join("?" * len(names)), ", ".join(f'"{c}"' for c in names)

    def whole(values: list[tuple]) -> pa.RecordBatch:
        con = sqlite3.connect(":memory:")
        con.execute(f'CREATE TABLE "{table}" ({columns})')
        con.executemany(f'INSERT INTO "{table}" VALUES ({marks})', values)
        con.commit()
        blob = con.serialize()
        con.close()
        return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["database"])

    def work(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= most:
                yield whole(held[:most])
                del held[:most]
        if held:
            yield whole(held)

    rows.mapInArrow(work, "database binary").write.parquet(path)


def databases_after(spark: SparkSession, path: str, table: str, column: str, mark: int, schema: str) -> DataFrame:
    """Rows of SQLite databases (``write_databases``) after a mark; the predicate goes to the
    databases, each read by the task that has it."""
    import sqlite3

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    found = spark.read.schema("database binary").parquet(path)
    kind = to_arrow_schema(found.sparkSession.createDataFrame([], schema).schema)
    columns = ", ".join(f'"{c}"' for c in kind.names)

    def work(batches):
        for batch in batches:
            for blob in batch.column(0):
                con = sqlite3.connect(":memory:")
                con.deserialize(blob.as_py())
                rows = con.execute(f'SELECT {columns} FROM "{table}" WHERE "{column}" > ?', (mark,)).fetchall()
                con.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    return found.mapInArrow(work, schema)


def names_only(rows: DataFrame, column: str) -> DataFrame:
    """An array of structs with a name, as the array of the names."""
    return rows.withColumn(column, F.transform(column, lambda x: x["name"]))


def names_as_structs(rows: DataFrame, column: str, **defaults: str) -> DataFrame:
    """An array of names as structs, with fixed values for what names don't tell."""
    return rows.withColumn(column, F.transform(column, lambda x: F.struct(x.alias("name"), *(F.lit(v).alias(k) for k, v in defaults.items()))))
