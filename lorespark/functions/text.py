"""Text expressions: normal forms, similarity, scores, chunks, intents."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GENERIC_DOMAINS

# Patterns and words that decide results.
SUFFIXES = r"\b(jr|sr|ii|iii|iv|esq|phd|md|dds)\b\.?"
TONES = {
    "urgent": ["urgent", "asap", "immediately", "critical", "deadline"],
    "positive": ["excited", "great", "pleased", "happy", "looking forward", "progress", "agreed"],
    "negative": ["concerned", "frustrated", "disappointed", "problem", "issue", "delay", "risk"],
    "formal": ["proposal", "agreement", "contract", "terms", "compliance"],
    "collaborative": ["partnership", "together", "collaborate", "aligned", "synergy"],
}
#: "tell assistant": the name by which users address the system.
INTENTS = [
    ("action", r"^(draft|send|email|schedule|remind|book|create|set up|approve|reject)\b"),
    ("action", r"\b(draft an? email|send an? email|schedule a? meeting|remind me|set a? reminder)\b"),
    ("correction", r"^(actually|no,|correct|update|change|mark|tell assistant|that's wrong)\b"),
    ("correction", r"\bis (a |an )?(vendor|client|partner|employee|carrier|broker)\b"),
    ("search", r"^(find|search|who is|when did|look up|show me|get me)\b"),
    ("investigation", r"^(analyze|compare|investigate|why is|deep dive|full picture|what should)\b"),
]
TROUBLE = r"\b(stalling|failing|behind|overdue|risk|problem)\b"
TEMPORAL_WORDS = ["today", "yesterday", "this week", "last week", "this month", "last month", "recently", "recent", "latest", "new", "changed", "updated", "what happened", "catch up", "catch me up"]


def normalize_name(name: Column) -> Column:
    """Lower case without suffixes, initials, and all but letters, blanks and hyphens."""
    x = F.regexp_replace(F.lower(name), SUFFIXES, "")
    x = F.regexp_replace(x, r"\b[a-z]\.\s*", "")
    x = F.regexp_replace(x, r"[^a-z\s-]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def header_name(header: Column) -> Column:
    """The name in ``Name <mail>``, empty for a bare address, else null."""
    name = F.regexp_replace(F.regexp_extract(header, r"^(.+?)\s*<(.+?)>$", 1), r'^"|"$', "")
    bare = header.contains("@") & ~header.contains(" ")
    return F.when(header.rlike(r"^(.+?)\s*<(.+?)>$"), F.trim(name)).when(bare, "")


def header_mail(header: Column) -> Column:
    bare = header.contains("@") & ~header.contains(" ")
    return F.when(header.rlike(r"^(.+?)\s*<(.+?)>$"), F.lower(F.regexp_extract(header, r"^(.+?)\s*<(.+?)>$", 2))).when(bare, F.lower(header))


def mail_domain(mail: Column) -> Column:
    """The part after the only @, null for generic providers."""
    parts = F.split(F.lower(mail), "@")
    return F.when((F.size(parts) == 2) & ~parts[1].isin(GENERIC_DOMAINS), parts[1])


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def bigrams(text: Column) -> Column:
    """The set of letter pairs of the lower-case text's letters, digits and blanks."""
    x = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))
    return F.when(F.length(x) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two bigram sets."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def tf_saturation(tokens: Column, terms: list[str], average: Column | float, k1: float = 1.5, b: float = 0.75) -> Column:
    """Saturated term frequencies, summed over the terms (each as often as given)."""
    size = F.size(tokens)
    out = F.lit(0.0)
    for term in terms:
        tf = F.size(F.filter(tokens, lambda w: w == F.lit(term)))
        out = out + tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))
    return out


def chunks(text: Column, length: int = 4000, overlap: int = 500) -> Column:
    """Overlapping pieces, in order."""
    step = length - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - overlap), F.lit(step))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(length)))


def intent(message: Column) -> Column:
    lower = F.trim(F.lower(message))
    out = F
    for value, pattern in INTENTS:
        out = out.when(lower.rlike(pattern), value)
    return out.when(lower.rlike(TROUBLE) & (F.length(lower) > 30), "investigation").otherwise("question")


def tones(text: Column) -> Column:
    """Which tones' words the text contains."""
    lower = F.lower(text)
    found = [F.when(lower.rlike("|".join(ws)), t) for t, ws in TONES.items()]
    return F.array_compact(F.array(*found))


def like_any(columns: list[str], needle: str) -> Column:
    """Case-insensitive containment in any column; % and _ are ordinary."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return out


def has_temporal_intent(query: str) -> bool:
    return any(w in query.lower() for w in TEMPORAL_WORDS)


def temporal_since(query: str, as_of: datetime) -> datetime:
    """The lower bound that a query's words ask for (weeks begin on Sunday)."""
    q, day = query.lower(), as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    sunday = day - timedelta(days=(day.weekday() + 1) % 7)
    first = day.replace(day=1)
    for phrase, bound in (("today", day), ("yesterday", day - timedelta(days=1)), ("this week", sunday), ("last week", sunday - timedelta(days=7)), ("this month", first), ("last month", (first - timedelta(days=1)).replace(day=1))):
        if phrase in q:
            return bound
    return as_of - timedelta(days=7)


def artifact_body(text: Column) -> Column:
    """The bodies of artifact tags in a text."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<antArtifact[^>]*>(.*?)</antArtifact>"), F.lit(1))


def without_artifacts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<antArtifact[^>]*>.*?</antArtifact>", "[artifact]")


def tail(memory: Column, addition: Column, n: int) -> Column:
    """Append and keep the last n characters."""
    return F.right(F.concat(F.coalesce(memory, F.lit("")), F.lit("\n"), addition), F.lit(n))


def frontmatter(text: Column) -> Column:
    """The key-value map between leading --- lines."""
    body = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    return F.when(body != "", F.map_from_entries(F.transform(F.filter(F.split(body, "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))))))


def set_field(json: Column, name: str, value: str) -> Column:
    """The JSON object with a top field set to a JSON value; text that is no object
    becomes one of that field alone."""
    rest = F.map_filter(F.from_json(json, "map<string, variant>"), lambda k, v: k != name)
    own = F.create_map(F.lit(name), F.parse_json(F.lit(value)))
    return F.to_json(F.map_concat(F.coalesce(rest, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), own))


# What tells the kind of an artifact, in the order in which they are tried.
CODE_FILES = ["tsx", "jsx", "ts", "js", "py"]
CODE_MARKS, HTML_MARKS, SVG_MARKS = ["import ", "function "], ["<html", "<!DOCTYPE"], ["<svg"]

# Domain terms and their tags.
DOMAIN_TERMS = [
    (r"(?i)\bgp\s*[/&]\s*lp\b", "GP/LP"),
    (r"(?i)\bgeneral partner", "general-partner"),
    (r"(?i)\blimited partner", "limited-partner"),
    (r"(?i)\bterm\s*sheet", "term-sheet"),
    (r"(?i)\bspv\b", "SPV"),
    (r"(?i)\bequity\b", "equity"),
    (r"(?i)\bacquisition", "acquisition"),
    (r"(?i)\bmerger", "merger"),
    (r"(?i)\bvaluation", "valuation"),
    (r"(?i)\bcap\s*table", "cap-table"),
    (r"(?i)\bdue\s*diligence", "due-diligence"),
    (r"(?i)\bipo\b", "IPO"),
    (r"(?i)\bseries\s*[a-d]\b", "fundraising"),
    (r"(?i)\bloi\b", "LOI"),
    (r"(?i)\bletter\s*of\s*intent", "LOI"),
    (r"(?i)\bescrow\b", "escrow"),
    (r"(?i)\bdebt\b", "debt"),
    (r"(?i)\bcollateral\b", "collateral"),
    (r"(?i)\binsurance", "insurance"),
    (r"(?i)\bpolicy\b", "policy"),
    (r"(?i)\bunderwriting", "underwriting"),
    (r"(?i)\bcompliance", "compliance"),
    (r"(?i)\bregulat", "regulatory"),
    (r"(?i)\bcontract\b", "contract"),
    (r"(?i)\binvoice", "invoice"),
    (r"(?i)\bbudget", "budget"),
    (r"(?i)\brevenue", "revenue"),
    (r"(?i)\bprofit", "profit"),
    (r"(?i)\bcash\s*flow", "cash-flow"),
    (r"\bROI\b", "ROI"),
]


def artifact_type(file_type: Column, content: Column) -> Column:
    """code, html, svg or document, by the file's type and marks in its content."""
    has = lambda marks: reduce(lambda a, b: a | b, (content.contains(m) for m in marks))
    kind = F.coalesce(file_type, F.lit("unknown"))
    return F.when(kind.isin(CODE_FILES) | has(CODE_MARKS), "code").when(has(HTML_MARKS), "html").when((kind == "svg") | has(SVG_MARKS), "svg").otherwise("document")


def domain_terms(text: Column) -> Column:
    """The tags of the domain terms in a text, each once, in the list's order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(p), tag) for p, tag in DOMAIN_TERMS))))
