"""Secret scans: fixed patterns, and dictionary-primed compression novelty.

The base patterns give spans of the kinds assign, access and hex.  The method
adds spans of the kind novel: a string of 20 or more key characters, with a
letter and a digit, that follows a sensitive word closely (or the rest of a
string in which such a word stands) and overlaps no base span is compressed by
zstandard after its surroundings (without further copies of it), with a
dictionary of identifiers loaded: the names of Python's own language and
standard modules, and words of configuration files.  The bytes that it adds per character are its
novelty; at ``NOVELTY`` or more nothing around it explains it, and it is
reported.  Base spans carry their novelty as well.

Spans are in code points, end exclusive.  Defined results: a null or empty text
has no spans; repeated rows each give a row; a null doc_id is carried; an empty
table gives an empty result; further columns are ignored or, with ``carry``,
kept.
"""

from __future__ import annotations

import builtins
import importlib
import keyword
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, strings, table

# The contract's patterns and their kinds, in the contract's order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "novel"]

SENSITIVE = re.compile(r"(?<![A-Za-z0-9])(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|bearer|credentials?)(?![A-Za-z0-9])", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Characters between the sensitive word's end and a candidate's start.
REACH = 48
#: Characters on each side that count as surroundings.
AROUND = 400
NOVELTY = 0.6

#: Words of configuration files; they stand last, where zstandard finds them cheapest.
CONFIGURATION = (
    "password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret authorization bearer "
    "credentials username config settings environment variable default example placeholder changeme your_token_here "
    "public static final string return function import export const class self this value name key id type data "
    "request response header content length http https www com org net json xml html utf8 base64 sha256 md5 uuid "
    "get set put post delete update insert select from where order group by limit true false null none undefined "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
#: Modules whose public names are identifiers that code is full of.
MODULES = ("os", "sys", "re", "json", "logging", "string", "socket", "ssl", "hashlib", "hmac", "secrets", "sqlite3", "http.client", "http.cookies", "urllib.parse", "urllib.request", "email.message", "configparser", "argparse", "datetime", "threading", "subprocess", "asyncio", "unittest.mock", "xml.dom.minidom")


@cache
def identifiers() -> bytes:
    """The dictionary: the same bytes wherever the same Python runs."""
    names = {*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names}
    for module in MODULES:
        names |= {n for n in dir(importlib.import_module(module)) if not n.startswith("_")}
    return " ".join([*sorted(names), CONFIGURATION]).encode()


_SPAN = "array<struct<kind: string, start: int, end: int, novelty: double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def _around(text: str, start: int, end: int) -> str:
    """The surroundings of a string, with blanks for further copies of it, also of
    those that the edge cuts: a copy doesn't explain it.  Copies may differ in what
    a ``=`` joins to them."""
    own = text[start:end]
    pieces = {p for p in own.split("=") if 20 <= len(p) < len(own)}

    def side(first: int, last: int, lo: int, hi: int) -> str:
        part = text[lo:hi].replace(own, " " * len(own))
        if len(pieces) > 4:  # whole pieces only, in one pass
            part = PIECE.sub(lambda m: " " * len(m[0]) if m[0] in pieces else m[0], part)
        else:
            for piece in pieces:
                part = part.replace(piece, " " * len(piece))
        return part[first - lo : last - lo]

    first, last = max(0, start - AROUND), end + AROUND
    return side(first, start, max(0, first - len(own)), start) + side(end, last, end, last + len(own))


class Novelty:
    """Marginal compressed bytes of a string, a character."""

    def __init__(self) -> None:
        words = zstandard.ZstdCompressionDict(identifiers(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # the strongest match finder: what names explain then costs least (random keys
        # add .76 bytes a character at least, short hex .67, most identifiers under .6)
        how = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=15, search_log=7, min_match=3, target_length=256, strategy=zstandard.STRATEGY_BTULTRA,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        words.precompute_compress(compression_params=how)
        self.press = zstandard.ZstdCompressor(dict_data=words, compression_params=how).compress

    def __call__(self, text: str, start: int, end: int) -> float:
        near = _around(text, start, end).encode()
        own = text[start:end].encode()
        return (len(self.press(near + own)) - len(self.press(near))) / max(1, len(own))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings that a sensitive word reaches: whole ones that begin within reach of
    it, or the rest of one in which it stands.  A string is judged once, from the
    first word that reaches it; words and strings are walked through together, so
    the time is linear in the text."""
    words = [m.end() for m in SENSITIVE.finditer(text)]
    at = 0
    for m in CANDIDATE.finditer(text) if words else ():
        s, e = m.span()
        while at < len(words) and words[at] + REACH < s:
            at += 1
        if at == len(words):
            return
        start = max(s, words[at])
        if e - start >= 20:
            yield start, e


def scan(text: str, novelty: Novelty) -> list[dict]:
    base = base_spans(text)
    found = [(s, k, e, novelty(text, s, e)) for s, k, e in base]
    starts = [s for s, *_ in base]
    ends = list(accumulate((e for *_, e in base), max))
    for s, e in candidates(text):
        before = bisect_left(starts, e)
        if before and ends[before - 1] > s:
            continue
        own = text[s:e]
        if re.search("[0-9]", own) and re.search("[A-Za-z]", own) and (rate := novelty(text, s, e)) >= NOVELTY:
            found.append((s, 3, e, rate))
    return [{"kind": KINDS[k], "start": s, "end": e, "novelty": n} for s, k, e, n in sorted(found)]


def redact(text: str, spans: list[dict], by: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced."""
    parts, at = [], 0
    for span in spans:
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            parts += [text[at : span["start"]], by]
        at = span["end"]
    return "".join([*parts, text[at:]])


def find_secrets(docs: DataFrame, carry: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """``doc_id, spans`` of every row, the columns named in ``carry``, and with
    ``redacted`` the text without its secrets as ``redacted``."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", *(carry or []), F.col("text").alias("_scanned"))
    width = len(rows.columns) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            texts = strings(batch.column(width)).to_pylist()
            spans = [scan(t, novelty) for t in texts]
            arrays, names = list(batch.columns[:width]), batch.schema.names[:width]
            if redacted:
                whole = batch.column(width).to_pylist()
                arrays.append(pa.array([w if w is None else redact(w, s) for w, s in zip(whole, spans, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, _SPAN_TYPE)], [*names, "spans"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width])
    return rows.mapInArrow(work, kept + ", redacted string" * redacted + f", spans {_SPAN}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
