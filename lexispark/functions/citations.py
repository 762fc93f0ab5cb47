"""Citation extraction (a vectorised function) and the check of answers against accepted citations.

Law citations come from direct mentions (``Art. 12 Abs. 1 OR``) and from lists
whose code follows at the end (``Art. 12, 13 und 14 OR``). Lists are positional:
a scan over codes and separators keeps where the current segment begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept, ship

# Codes, their German names, labels of subdivisions, patterns.
CODES = {"CPP": "StPO", "CPC": "ZPO", "CP": "StGB", "CC": "ZGB", "CO": "OR", "LCR": "SVG", "LTF": "BGG", "LOAP": "StBOG", "LPGA": "ATSG", "LAI": "IVG", "LDIP": "IPRG", "Cst.": "BV", "Cst": "BV"}
LABELS = {"al.": "Abs. ", "alinéa": "Abs. ", "let.": "lit. ", "ch.": "Ziff. ", "cifra": "Ziff. "}
CODE = r"StPO|StGB|ZGB|OR|ZPO|SVG|BGG|StBOG|ATSG|IVG|IPRG|BV|CPP|CP|CC|CO|CPC|LCR|LTF|LOAP|LPGA|LAI|LDIP|Cst\.?"
NUMBER = r"[0-9]+[a-z]?(?:/[0-9]+)?"
TAIL = r"(?:\s*(?:Abs\.|al\.|alinéa|lit\.|let\.|Ziff\.|ch\.|cifra)\s*[0-9a-z]+)*"
AND = r"(?:et|und|and)"
CONSIDERATIONS = rf"[\dA-Za-z_.-]+(?:\s*(?:,|et|und|and)\s*[\dA-Za-z_.-]+)*"
#: Longest segment in front of a code that is read as a list.
SEGMENT = 600

_any = re.IGNORECASE
_direct = re.compile(rf"\bArt\.\s*({NUMBER})({TAIL})\s*({CODE})\b", _any)
_border = re.compile(rf"\b(?P<code>{CODE})\b|[;(]", _any)
_listed = re.compile(rf"(?:\bArt\.\s*|[,;]|\bet\b|\bund\b|\band\b)\s*({NUMBER})({TAIL})", _any)
_range = re.compile(rf"(Abs\.|al\.|alinéa)\s*([0-9]+)\s*{AND}\s*([0-9]+)", _any)
_listed_range = re.compile(rf"\bArt\.\s*({NUMBER})\s*(Abs\.|al\.|alinéa)\s*([0-9]+)\s*{AND}\s*([0-9]+)(?!\s*(?:Abs\.|al\.|alinéa))", _any)
_label = re.compile(r"\b(al\.|alinéa|let\.|ch\.|cifra)\s*", _any)
_space = re.compile(r"\s+")
_child = re.compile(r"(Art\.\s+\S+\s+Abs\.\s+\S+)\s+lit\.\s+\S+\s+(\S+)")
_first_number = re.compile(r"\b(?:ch\.|Ziff\.)\s*1\b", _any)
_article = re.compile(r"\bart\.", _any)
_plain_courts = tuple(
    re.compile(p) for p in (r"\bBGE\s+\d+\s+[IVX]+\s+\d+\s+E\.\s*[\dA-Za-z_.-]+", r"\bBGE\s+\d+\s+[IVX]+\s+\d+", r"\b\d+[A-Z]_\d+/\d{4}\s+E\.\s*[\dA-Za-z_.-]+", r"\b\d+[A-Z]_\d+/\d{4}")
)
_court_lists = (
    ("BGE {} E. {}", re.compile(rf"\bATF\s+(\d+\s+[IVX]+\s+\d+)\s+(?:consid\.|c\.)\s*({CONSIDERATIONS})", _any)),
    ("BGE {} E. {}", re.compile(rf"\bBGE\s+(\d+\s+[IVX]+\s+\d+)\s+(?:consid\.|c\.|E\.)\s*({CONSIDERATIONS})", _any)),
    ("{} E. {}", re.compile(rf"\b([1-9][A-Z]_\d+/\d{{4}})\b(?:.{{0,120}}?)(?:consid\.|c\.|E\.)\s*({CONSIDERATIONS})", _any | re.DOTALL)),
)
_between = re.compile(r"\s*(?:,|et|und|and)\s*")


def _forms(number: str, tail: str, code: str) -> Iterator[str]:
    """The canonical form of one article, and its parent paragraph if it names a letter of one."""
    tail = _space.sub(" ", _label.sub(lambda m: LABELS[m[1].lower()], tail)).strip(" ,;.")
    form = f"Art. {number} {tail} {CODES.get(code, code)}".replace("  ", " ").strip()
    yield form
    if parent := _child.fullmatch(form):
        yield f"{parent[1]} {parent[2]}"


def _with_ranges(number: str, tail: str, code: str) -> Iterator[str]:
    yield from _forms(number, tail, code)
    for found in _range.finditer(tail):
        yield from _forms(number, _range.sub(f"{found[1]} {found[3]}", tail, count=1), code)


def law_citations(text: str) -> set[str]:
    laws: set[str] = set()
    for number, tail, code in _direct.findall(text):
        laws.update(_with_ranges(number, tail, code))
        if CODES.get(code, code) == "StGB" and _first_number.search(tail):
            laws.add(f"Art. {number} Abs. 1 StGB")
    begin = 0
    for border in _border.finditer(text):
        code = border["code"]
        if code and border.start() - begin <= SEGMENT and _article.search(segment := text[begin : border.start()]):
            for number, label, first, second in _listed_range.findall(segment):
                for value in (first, second):
                    laws.update(_forms(number, f"{label} {value}", code))
            for number, tail in _listed.findall(segment):
                laws.update(_with_ranges(number, tail, code))
        begin = border.end()
    return laws


def court_citations(text: str) -> set[str]:
    courts = {_space.sub(" ", m).strip(" .;,:") for p in _plain_courts for m in p.findall(text)}
    for shape, pattern in _court_lists:
        for reference, items in pattern.findall(text):
            reference = _space.sub(" ", reference).strip()
            courts.update(shape.format(reference, v.strip()) for v in _between.split(items) if v.strip())
    return courts


_LIST = T.ArrayType(T.StringType())


@F.pandas_udf(T.StructType([T.StructField("laws", _LIST), T.StructField("courts", _LIST)]))
def _extract(texts: pd.Series) -> pd.DataFrame:
    pairs = [(sorted(law_citations(t)), sorted(court_citations(t))) for t in texts.fillna("")]
    return pd.DataFrame({"laws": [p[0] for p in pairs], "courts": [p[1] for p in pairs]})


#: Texts that match this may hold a citation; others never reach Python.
MAY_CITE = r"(?iuU)art\.|bge|atf|\d[a-z]_\d"


def with_citations(df: DataFrame, text: str, name: str = "citations") -> DataFrame:
    """Adds ``name``: struct(laws, courts), both sorted and distinct."""
    ship(df.sparkSession)
    none = F.struct(F.array().cast("array<string>").alias("laws"), F.array().cast("array<string>").alias("courts"))
    worth = F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit(MAY_CITE))
    # The function sees null for texts that cannot hold a citation, so they cost no transfer.
    return df.withColumn(name, _extract(F.when(worth, F.col(text)))).withColumn(name, F.when(worth, F.col(name)).otherwise(none))


def all_citations(found: Column) -> Column:
    """Laws and courts in one sorted, distinct array."""
    return F.array_sort(F.array_union(found["laws"], found["courts"]))


SURFACE = r"(?U)\bArt\.\s*[0-9]+[a-z]?(?:/[0-9]+)?(?:\s+(?:Abs\.|al\.|alinéa|lit\.|let\.|Ziff\.|ch\.|cifra)\s*[0-9a-z]+)*\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöü.]{1,15}\b"


def validate_answers(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Checks answers (answer_id, answer, accepted array) in order; the first failing rule is ``problem``.

    Rules: a mentioned citation is outside the vocabulary; is not accepted; is
    not written exactly (a parent of an exact ``lit.`` mention may be); an
    article-like surface is no exact mention.
    """
    from .text import clean, matches

    # Extraction is the costly step and both sides of the join need it.
    said = kept(with_citations(answers, "answer", "__found").withColumn("mentioned", all_citations(F.col("__found"))).drop("__found"), "answers")
    known = said.select("answer_id", F.explode("mentioned").alias("citation")).join(vocabulary.select("citation"), "citation", "left_semi").groupBy("answer_id").agg(F.collect_set("citation").alias("__known"))
    df = said.join(known, "answer_id", "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))
    exact = F.filter("mentioned", lambda c: F.contains(F.col("answer"), c))
    df = df.withColumn("exact_mentioned", exact)
    shape = r"^(Art\.\s+\S+\s+Abs\.\s+\S+)\s+(\S+)$"
    parent = lambda c: F.exists(
        F.col("exact_mentioned"),
        lambda e: F.rlike(c, F.lit(shape)) & F.rlike(e, F.lit(r"^Art\.\s+\S+\s+Abs\.\s+\S+\s+lit\.\s+\S+\s+\S+$")) & (F.regexp_replace(e, r"\s+lit\.\s+\S+\s+(\S+)$", " $1") == F.regexp_replace(c, r"\s+(\S+)$", " $1")),
    )
    outside = F.array_except("mentioned", "__known")
    unsupported = F.array_except("mentioned", "accepted")
    inexact = F.filter("mentioned", lambda c: ~F.array_contains(F.col("exact_mentioned"), c) & ~parent(c))
    strange = F.array_except(F.transform(matches(F.col("answer"), SURFACE), clean), F.col("exact_mentioned"))
    problem = F.when(F.size(outside) > 0, "outside vocabulary").when(F.size(unsupported) > 0, "not accepted").when(F.size(inexact) > 0, "not exact").when(F.size(strange) > 0, "unrecognised surface")
    offending = F.when(F.size(outside) > 0, outside).when(F.size(unsupported) > 0, unsupported).when(F.size(inexact) > 0, inexact).otherwise(strange)
    return df.select("answer_id", "mentioned", "exact_mentioned", problem.alias("problem"), offending.alias("offending"))
