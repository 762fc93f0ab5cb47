"""Small tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

_WORDS = {
    "en": "the of and to in that is for with on this from are by at be have it not which".split(),
    "de": "der die und den das ist mit auf für nicht von werden ein eine sich dem auch schön".split(),
}


def sentence(draw: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(draw.choice(_WORDS[lang]) + draw.choice(["", "", str(draw.randint(0, 99))]) for _ in range(n))


def corpus(spark, n: int = 60, seed: int = 1):
    """Documents with exact and near copies, nulls, empty, one very long, odd white space, clashing columns."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(["en", "de"])
        rows.append([i, sentence(draw, draw.randint(30, 90), lang), lang, f"s{i % 3}"])
    for i in range(3, 12):
        rows[i][1], rows[i][2] = rows[2][1], rows[2][2]
    base = rows[20][1].split()
    for i in range(21, 28):
        words = list(base)
        words[draw.randrange(len(words))] = "changed"
        rows[i][1], rows[i][2] = "  \t".join(words).upper() if i == 27 else " ".join(words), rows[20][2]
    shared = sentence(draw, 45)
    for i in range(40, 45):
        rows[i][1] = f"{sentence(draw, 12)} {shared} {sentence(draw, 9)}"
        rows[i][2] = "en"
    rows[50][1] = sentence(draw, 20_000)
    rows[51][1] = f"{shared} {shared}"
    rows[52][1], rows[53][1], rows[54][1], rows[55][1] = None, "", " \n ", "two words"
    rows[50][2] = rows[51][2] = "en"
    rows[56][2] = rows[56][3] = None
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    return df.selectExpr("*", "'x' as size", "1 as target", "'k' as kept", "0 as component_id", "'t' as shard")


def plain(df):
    """doc_id to text, null as it is."""
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
