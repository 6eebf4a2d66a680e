"""Quality rules with thresholds from mergeable quantile sketches.

Every document's measures are taken over its whole text.  Each language and
source gets a sketch of each measure: a histogram whose bins are the measure's
first ``BITS`` significant bits (in units of 2^-``SCALE``), so quantiles are exact
to one part in 2^(``BITS`` - 1).  Histograms merge by adding up, in any order and
grouping, so a rerun gives the same thresholds; they are aggregated where the rows
are before anything moves, so a source with a third of the rows is no burden.

Small groups borrow from larger ones, all by one rule: the language's and the whole
corpus' histograms count in every group as ``PRIOR`` / 2 further documents each.
Counts are scaled to whole numbers, so nothing is rounded.

A threshold is the upper quartile plus ``WIDTH`` scales, a scale being the
quartile range, or a part of the distance from the median to the 98th
percentile where that is larger (a measure that is 0 in most documents has no
quartile range).  For the share of distinct words it is the same below the lower
quartile.  A document beyond any threshold of its group isn't kept.

Defined results: a null or empty text has no words and fails the base rules;
null languages and sources are groups of their own; repeated rows each give a
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _SPACE, materialize, mix, prefix_hash, prepare, slices, span_hash, table, utf8, window_hash, word_spans

WINDOW = 8
PRIOR = 100
BITS = 7
SCALE = 20
WIDTH = 3.0
#: Thresholds of up to so many groups (100 bytes each) are broadcast; more are
#: joined by shuffle, where both sides are tables and a hot group is split.
BROADCAST_GROUPS = 50_000
#: Measures, the side that is bad, and by what the distance to the far percentile is divided.
MEASURES = {"symbol_share": (1, 25), "upper_share": (1, 25), "dup_line_share": (1, 6), "repeat_share": (1, 6), "distinct_share": (-1, 6)}
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper"]


def measures(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(offs) - 1

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[offs[1:]] - sums[offs[:-1]]

    starts, ends, doc = word_spans(data, offs)
    sums = prefix_hash(data)
    words = span_hash(sums, starts, ends)
    salt = mix(np.arange(n, dtype=np.uint64))
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = within(((data & 0xC0) != 0x80) & ~_SPACE[data])
    out["n_symbols"] = within(_SYMBOL[data])
    out["n_upper"] = within((data >= 65) & (data <= 90))

    def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys occur again, and which are the first of their kind."""
        order = np.argsort(keys, kind="stable")
        own = keys[order]
        same = own[1:] == own[:-1]
        again, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        first[order[1:][same]] = False
        return again, first

    # lines with a word, by content
    line_ends = np.union1d(np.flatnonzero(data == 10), offs[1:] - 1) + 1 if len(data) else np.zeros(0, np.int64)
    line_ends = line_ends[line_ends > 0]
    line_starts = np.concatenate([[0], line_ends[:-1]]).astype(np.int64)[: len(line_ends)]
    line_doc = np.searchsorted(offs, line_starts, "right") - 1
    text_ends = line_ends - (data[line_ends - 1] == 10) if len(line_ends) else line_ends
    lit = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_SPACE[data], out=lit[1:])
    full = lit[text_ends] > lit[line_starts]
    keys = mix(span_hash(sums, line_starts[full], text_ends[full]) ^ salt[line_doc[full]])
    _, first = repeated(keys)
    out["n_lines"] = np.bincount(line_doc[full], minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[full][~first], minlength=n)

    _, first = repeated(mix(words ^ salt[doc]))
    out["n_distinct"] = np.bincount(doc[first], minlength=n)

    runs = window_hash(words, WINDOW)
    whole = doc[: len(runs)] == doc[WINDOW - 1 :] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    again, _ = repeated(mix(runs[at] ^ salt[doc[at]]))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(batch.column(3))
        parts = [measures(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
        columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in _COUNTS]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "lang", "source", *_COUNTS])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the counts and the measures of every row."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "source", "text")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return rows.mapInArrow(_measure, kept + "".join(f", {k} long" for k in _COUNTS)).withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("n_upper", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "distinct_share": share("n_distinct", "n_words"),
        }
    )


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, m`` (number of the measure), ``bin, c``."""
    bins = []
    for i, m in enumerate(MEASURES):
        units = f"CAST(floor({m} * {1 << SCALE}D) AS BIGINT)"
        low = f"greatest(length(bin({units})) - {BITS}, 0)"
        bins.append(F.struct(F.lit(i).alias("m"), F.expr(f"shiftleft(shiftright({units}, {low}), {low})").alias("bin")))
    return rows.select("lang", "source", F.explode(F.array(*bins)).alias("x")).groupBy("lang", "source", "x.m", "x.bin").agg(F.count("*").alias("c"))


def thresholds(rows: DataFrame) -> DataFrame:
    """``lang, source`` and each measure's threshold, for every group of rows."""
    own = materialize(sketches(rows), "sketches")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    sizes = own.filter("m = 0").groupBy("lang", "source").agg(F.sum("c").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("nl"))
    every = own.groupBy("m", "bin").agg(F.sum("c").alias("ca"))  # at most 5 x 2^(BITS - 1) x (SCALE + 3 - BITS) rows
    numbers = F.explode(F.array(*(F.lit(i) for i in range(len(MEASURES)))))
    prior = own.select("lang", "m", "bin", (wide("c") * total).alias("w")).unionByName(
        langs.withColumn("m", numbers).join(F.broadcast(every), "m").select("lang", "m", "bin", (wide("ca") * wide("nl")).alias("w"))
    )
    prior = prior.groupBy("lang", "m", "bin").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    of_lang = langs.select(F.col("lang").alias("k"), "nl")
    per_lang = F.col("lang").eqNullSafe(F.col("k"))
    counted = own.join(of_lang, per_lang).select("lang", "source", "m", "bin", (wide("c") * wide("nl") * (2 * total)).cast("decimal(38,0)").alias("w"))
    lent = sizes.select("lang", "source").join(prior.withColumnRenamed("lang", "k"), per_lang).select("lang", "source", "m", "bin", (F.col("w") * PRIOR).cast("decimal(38,0)").alias("w"))
    mixed = counted.unionByName(lent).groupBy("lang", "source", "m", "bin").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    group = Window.partitionBy("lang", "source", "m")
    upto = mixed.withColumn("upto", F.sum("w").over(group.orderBy("bin")) * 100).withColumn("all", F.sum("w").over(group))
    at = lambda m, r: F.min(F.when((F.col("m") == m) & (F.col("upto") >= F.col("all") * r), F.col("bin").cast("double")))
    limits = []
    for i, (m, (side, part)) in enumerate(MEASURES.items()):
        near, far = (75, 98) if side > 0 else (25, 2)
        scale = F.greatest(at(i, 75) - at(i, 25), F.abs(at(i, far) - at(i, 50)) / F.lit(float(part)))
        limits.append(((at(i, near) + F.lit(side * WIDTH) * scale) / F.lit(float(1 << SCALE))).alias(f"{m}_limit"))
    return upto.groupBy("lang", "source").agg(*limits)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures, thresholds and verdict (``kept``) of every row."""
    rows = materialize(measured(docs), "measures")
    limits = materialize(thresholds(rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"}), "limits")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    beyond = F.lit(False)
    for m, (side, _) in MEASURES.items():
        over = F.col(m) > F.col(f"{m}_limit") if side > 0 else F.col(m) < F.col(f"{m}_limit")
        beyond = beyond | F.coalesce(over, F.lit(False))
    return joined.drop("t_lang", "t_source").withColumn("base_failed", failed).withColumn("kept", ~failed & ~beyond)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SHARES = "n_symbols / nullif(word_chars, 0), n_upper / nullif(word_chars, 0), n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0), n_distinct / nullif(n_words, 0)"
_AT = lambda m, r: f"min(bin) FILTER (m = {m} AND upto * 100 >= total * {r})::DOUBLE"


def _sql() -> str:
    limits, beyond = [], []
    for i, (side, part) in enumerate(MEASURES.values()):
        near, far = (75, 98) if side > 0 else (25, 2)
        scale = f"greatest({_AT(i, 75)} - {_AT(i, 25)}, abs({_AT(i, far)} - {_AT(i, 50)}) / {part}.0::DOUBLE)"
        limits.append(f"({_AT(i, near)} + {side * WIDTH}::DOUBLE * {scale}) / {1 << SCALE}.0::DOUBLE AS limit{i}")
        beyond.append(f"shares[{i + 1}] {'>' if side > 0 else '<'} limit{i}")
    return rf"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY 1),
counts AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS.decode()}', '')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_distinct(w)) AS n_distinct, coalesce(n, 0) AS n_repeat_words FROM texts LEFT JOIN covered USING (doc_id)),
measured AS (SELECT *, list_transform([{_SHARES}], lambda x: coalesce(x, 0.0::DOUBLE)) AS shares FROM counts),
units AS (SELECT lang, source, m - 1 AS m, floor(shares[m] * {1 << SCALE})::BIGINT AS u FROM measured, range(1, {len(MEASURES) + 1}) AS r(m)),
own AS (SELECT lang, source, m, (u >> greatest(length(bin(u)) - {BITS}, 0)) << greatest(length(bin(u)) - {BITS}, 0) AS bin, count(*)::HUGEINT AS c FROM units GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c) AS n FROM own WHERE m = 0 GROUP BY ALL), langs AS (SELECT lang, sum(n) AS nl FROM sizes GROUP BY ALL), everything AS (SELECT sum(n) AS na FROM sizes),
prior AS (SELECT lang, m, bin, sum(w) AS w FROM (SELECT lang, m, bin, c * na AS w FROM own, everything UNION ALL
  SELECT lang, m, bin, sum(c) * nl FROM langs, own o(l_, s_, m, bin, c) GROUP BY lang, m, bin, nl) GROUP BY ALL),
mixed AS (SELECT lang, source, m, bin, sum(w) AS w FROM (SELECT o.lang, source, m, bin, c * nl * 2 * na AS w FROM own o JOIN langs x ON o.lang IS NOT DISTINCT FROM x.lang, everything UNION ALL
  SELECT s.lang, source, m, bin, w * {PRIOR} FROM sizes s JOIN prior p ON s.lang IS NOT DISTINCT FROM p.lang) GROUP BY ALL),
upto AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, m ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY lang, source, m) AS total FROM mixed),
limits AS (SELECT lang, source, {", ".join(limits)} FROM upto GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {" OR ".join(beyond)}) AS kept
FROM measured d JOIN limits g ON d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source
"""


#: The same, with exact sums.
OP9_SQL = _sql()
