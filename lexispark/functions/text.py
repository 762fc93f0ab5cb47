"""Text functions as Catalyst expressions: cleaning, query and document views, escaping, checks.

White space is what Python counts as such (it includes U+001C-U+001F and
U+0085); lengths and slices are in code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship

WHITE = r"[\s\x1c-\x1f\x85\p{IsWhite_Space}]+"

# Patterns, word lists and limits of the views.
FRAGMENT = r"(?U)\b(?:Art\.\s*[^,;.()]{1,80}|BGE\s+\d+\s+[IVX]+\s+\d+(?:\s+E\.\s*[\d.a-z]+)?|(?:\d[A-Z]?|[A-Z])_[0-9]+/[0-9]{4}(?:\s+E\.\s*[\d.a-z]+)?)"
KEYWORD = r"[A-Za-zÄÖÜäöüÉéÈèÀàÇç]{4,}|\d[A-Z]?_[0-9]+/[0-9]{4}"
DOCUMENT_CITATION = (
    r"(?U)\b(?:Art\.\s*\d+[a-zA-Z]*(?:\s*Abs\.\s*\d+[a-zA-Z]*)?(?:\s*(?:lit\.|Ziff\.)\s*[a-zA-Z0-9]+)?\s*[A-ZÄÖÜ]{2,}[A-ZÄÖÜ0-9-]*"
    r"|(?:BGE|ATF)\s+\d+\s+[IVX]+\s+\d+(?:\s+E\.\s*[\d.a-zA-Z/]+)?|\d+[A-Z]_[0-9]+/\d{4})\b"
)
LEGAL_WORDS = (
    "vorsorgliche Massnahmen", "superprovisorische Massnahmen", "Beweissicherung", "Zuständigkeit", "internationale Zuständigkeit",
    "Urheberrecht", "UWG", "unlauterer Wettbewerb", "Geschäftsgeheimnis", "Software", "Quellcode", "Mietrecht", "Leasing", "Verjährung",
    "Schuldanerkennung", "Kontokorrent", "Scheidung", "Kindesschutz", "Unterhalt", "Arbeitsfähigkeit", "Invalidenversicherung", "Unfall",
    "Haftpflicht", "SVG", "StPO", "Untersuchungshaft", "Kollusionsgefahr", "Verhältnismässigkeit", "Beschwerde", "Rechtsöffnung", "SchKG",
    "Erwägung", "Berufung", "Revision", "Ausstand", "Kündigung", "Arbeitsvertrag", "einfache Gesellschaft", "Liquidation", "Erbrecht",
    "Nachlass", "Markenschutz", "Datenschutz",
)
STOP_WORDS = (
    "that", "with", "from", "into", "under", "when", "while", "have", "been", "were", "this", "does", "should", "could", "would", "their", "there",
    "where", "after", "before", "alleged", "alleges", "claimant", "defendant", "plaintiff", "court", "legal", "risk", "claim", "claims", "order",
    "decision", "dated", "later", "whether", "meaning", "considering", "because", "between", "against", "upon", "within", "which", "those", "these",
)
FULLTEXT_FIELDS = ("regeste", "abstract_de", "abstract_fr", "abstract_it", "full_text")
LABELLED_FIELDS = (
    "decision_id", "docket_number", "docket_number_2", "decision_date", "publication_date", "court", "canton", "chamber", "language", "title",
    "legal_area", "regeste", "abstract_de", "abstract_fr", "abstract_it", "outcome", "decision_type", "appeal_info", "source_url", "pdf_url",
    "bge_reference", "cited_decisions",
)
CITATION_FIELDS = (
    "valid_law_citations", "valid_court_citations", "law_citations", "court_citations", "citations", "citation", "rootCitation", "gold_citations",
)
TOP_KEYWORDS, META_LIMIT, KEYWORD_LIMIT, HEAD_LIMIT, TAIL_LIMIT, SCANNED = 70, 2_200, 1_600, 700, 900, 120_000
PRIVATE_KEY = r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----"
QUOTED_SECRET = r"(?i)(?:access[_-]?key|api[_-]?key|auth[_-]?token|password|private[_-]?key|secret(?:[_-]?access[_-]?key)?|token)\s*[:=]\s*['\"]([A-Za-z0-9_./+=:@-]{20,})['\"]"
ENV_SECRET = r"(?m)^\s*(?:export\s+)?(?:[A-Z0-9_]*(?:ACCESS_KEY|API_KEY|AUTH_TOKEN|PASSWORD|PRIVATE_KEY|SECRET_ACCESS_KEY|TOKEN))\s*=\s*([A-Za-z0-9_./+=:@-]{20,})\s*(?:#.*)?$"
PLACEHOLDERS = ("changeme", "example", "fixture", "placeholder", "replace", "your-")


def clean(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " "))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def join_list(values: Column) -> Column:
    """Cleaned, non-empty items joined by ``' ; '``."""
    return F.array_join(F.filter(F.transform(values, clean), lambda v: v != ""), " ; ")


def split_citations(text: Column) -> Column:
    """The distinct citations of a ``;``-separated text, cleaned, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), clean), lambda v: v != ""))


def fragments(text: Column) -> Column:
    """Citation-like fragments of a query, distinct, first seen first."""
    return F.array_distinct(matches(text, FRAGMENT))


def legal_words(text: Column) -> Column:
    """The fixed phrases that a text contains, whatever their case, in the list's order."""
    return F.element_at(F.transform(F.array(F.lower(text)), lambda low: F.filter(F.array(*map(F.lit, LEGAL_WORDS)), lambda w: F.contains(low, F.lower(w)))), 1)


def clauses(text: Column) -> Column:
    """A cleaned text cut at white space after ``?``, ``;`` or ``.``."""
    return F.split(text, r"(?<=[?;.])\s+", -1)


def meta_view(query: Column) -> Column:
    """Citations, legal words, the first two clauses, and the last three (or all), joined by ``; ``."""
    # The cleaned text and its clauses are bound once each, or every use would clean and cut anew.
    bound = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    return bound(clean(query), lambda text: bound(F.struct(text.alias("text"), clauses(text).alias("parts")), _meta_pieces))


def _meta_pieces(cut: Column) -> Column:
    text, parts = cut["text"], cut["parts"]
    tail = F.when(F.size(parts) > 3, F.array_join(F.slice(parts, -3, 3), " ")).otherwise(text)
    pieces = [F.array_join(fragments(text), "; "), F.array_join(legal_words(text), ", "), F.substring(F.array_join(F.slice(parts, 1, 2), " "), 1, HEAD_LIMIT), F.substring(tail, 1, TAIL_LIMIT)]
    return F.substring(F.concat_ws("; ", *[F.nullif(p, F.lit("")) for p in pieces]), 1, META_LIMIT)


#: Texts whose keywords are held as Python objects at a time.
RANKED = 128
_RANKED = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("keyword", T.StringType()), T.StructField("n", T.LongType())]))


@F.arrow_udf(_RANKED)
def ranked_keywords(text: pa.Array) -> pa.Array:
    """Structs (place, keyword, n) of cleaned texts' TOP_KEYWORDS keywords, by count, ties by code point."""
    find, stop = re.compile(KEYWORD).finditer, frozenset(STOP_WORDS)
    parts, kind = [], to_arrow_type(_RANKED)
    for at in range(0, len(text), RANKED):
        ends, place, keyword, times = [0], [], [], []
        for t in text[at : at + RANKED]:
            counted: Counter = Counter()
            for k, n in Counter(m.group() for m in find(t.as_py() or "")).items():
                counted[k.lower()] += n
            top = sorted(((-n, k) for k, n in counted.items() if len(k) >= 4 and k not in stop))[:TOP_KEYWORDS]
            place += range(1, len(top) + 1)
            keyword += [k for _, k in top]
            times += [-n for n, _ in top]
            ends.append(len(place))
        rows = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(keyword, pa.string()), pa.array(times, pa.int64())], fields=list(kind.value_type))
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def keyword_ranking(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, keyword, n, place) of each text's TOP_KEYWORDS keywords: by count, ties by code point.

    A text's tokens are all on its row, so nothing is dealt out.
    """
    ship(texts.sparkSession)
    ranked = texts.select(key, ranked_keywords(clean(F.col(text))).alias("__r"))
    return ranked.select(key, F.explode("__r").alias("r")).select(key, "r.keyword", "r.n", "r.place")


def keyword_view(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, keywords): fragments and ranked keywords joined by spaces."""
    ship(texts.sparkSession)
    cleaned = texts.select(key, clean(F.col(text)).alias("__clean"))
    own = cleaned.select(key, F.array_join(fragments(F.col("__clean")), " ").alias("__fragments"), ranked_keywords(F.col("__clean")).alias("__r"))
    top = F.array_join(F.transform("__r", lambda s: s["keyword"]), " ")
    return own.select(key, F.substring(clean(F.concat_ws(" ", "__fragments", F.nullif(top, F.lit("")))), 1, KEYWORD_LIMIT).alias("keywords"))


def citation_view(query: Column) -> Column:
    """The raw query's fragments joined by spaces, or the query as it is."""
    return F.coalesce(F.nullif(clean(F.array_join(fragments(query), " ")), F.lit("")), query)


def query_views(queries: DataFrame, key: str = "query_id", query: str = "query") -> DataFrame:
    """The five views of each query; unique non-blank queries are assumed checked."""
    words = keyword_view(queries, key, query)
    return queries.join(words, key).select(
        key, F.col(query).alias("normal_query"), meta_view(F.col(query)).alias("meta_searchterm"), "keywords", F.col(query).alias("fulltext"), citation_view(F.col(query)).alias("citations")
    )


def with_overrides(views: DataFrame, meta: str, keywords: str) -> DataFrame:
    """Views whose meta term and keywords (an array) replace the made ones where they are not null."""
    words = F.array_distinct(F.filter(F.transform(F.col(keywords), clean), lambda w: w != ""))
    return views.withColumn("meta_searchterm", F.coalesce(F.substring(F.nullif(clean(F.col(meta)), F.lit("")), 1, META_LIMIT) if meta else F.lit(None), "meta_searchterm")).withColumn(
        "keywords", F.when(F.size(words) > 0, F.substring(clean(F.array_join(words, " ")), 1, KEYWORD_LIMIT)).otherwise(F.col("keywords"))
    )


def render_document(row: Sequence[str] = LABELLED_FIELDS, body: str = "full_text") -> Column:
    """``[field] value`` of every field that is not blank, then the body, joined by spaces; values stay raw."""
    blank = lambda c: F.trim(F.regexp_replace(F.col(c).cast("string"), WHITE, " ")) == ""
    return F.concat_ws(" ", *[F.when(~blank(c), F.concat(F.lit(f"[{c}] "), F.col(c).cast("string"))) for c in (*row, body)])


def fulltext_view(fields: Sequence[str] = FULLTEXT_FIELDS) -> Column:
    """``field: value`` lines of the cleaned, non-empty fields."""
    return F.concat_ws("\n", *[F.when(clean(F.col(c)) != "", F.concat(F.lit(f"{c}: "), clean(F.col(c)))) for c in fields])


def document_citations(lists: Sequence[Column], fields: Sequence[str] = FULLTEXT_FIELDS) -> Column:
    """Declared citations (joined lists) and those of the text's first 120,000 characters, distinct, in order."""
    source = F.concat_ws("\n", *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", clean(F.col(c))) for c in fields])
    values = F.concat(F.array(*lists) if lists else F.array().cast("array<string>"), matches(F.substring(source, 1, SCANNED), DOCUMENT_CITATION))
    return F.array_join(F.array_distinct(F.filter(F.transform(values, clean), lambda v: v != "")), " ; ")


def encoder_text(text: Column) -> Column:
    """Blank texts become one space, as encoders need."""
    return F.when(clean(text) == "", F.lit(" ")).otherwise(text)


def truncated(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and a mark, where a positive limit is exceeded."""
    value = F.coalesce(text, F.lit(""))
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit(" …[truncated]"))).otherwise(value) if limit else value


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def hit_text(citation: Column, title: Column, source: Column, text: Column) -> Column:
    """The lines of a sparse hit that are not empty; the text stays raw."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (clean(citation), clean(title), clean(source), text)])


def split_reasoning(content: Column) -> Column:
    """struct(answer, reasoning, problem) of a reply with an optional leading ``<think>`` block."""
    text = F.regexp_replace(F.regexp_replace(content, "^" + WHITE, ""), WHITE + "$", "")
    end = F.locate("</think>", text, 8)
    leads = F.startswith(text, F.lit("<think>"))
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, "^" + WHITE, ""), WHITE + "$", "")
    inside, after = trimmed(F.substring(text, F.lit(8), end - 8)), trimmed(F.substring(text, end + 8, F.length(text)))
    problem = (
        F.when(~leads & F.contains(text, F.lit("</think>")), F.lit("malformed"))
        .when(leads & (end == 0), F.lit("truncated"))
        .when(leads & (after == ""), F.lit("no answer"))
        .when(leads & (F.contains(after, F.lit("<think>")) | F.contains(after, F.lit("</think>"))), F.lit("nested"))
    )
    return F.struct(
        F.when(problem.isNull(), F.when(leads, after).otherwise(text)).alias("answer"),
        F.when(problem.isNull() & leads, F.nullif(inside, F.lit(""))).alias("reasoning"),
        problem.alias("problem"),
    )


def credential_problem(text: Column) -> Column:
    """Whether a text holds a private key block or an assigned value without a placeholder's mark."""
    real = lambda v: ~F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda p: F.contains(F.lower(v), p))
    return F.rlike(text, F.lit(PRIVATE_KEY)) | F.exists(matches(text, QUOTED_SECRET, 1), real) | F.exists(matches(text, ENV_SECRET, 1), real)


def citation_kind(citation: Column) -> Column:
    return F.when(F.startswith(citation, F.lit("Art. ")), F.lit("law")).otherwise(F.lit("court"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
