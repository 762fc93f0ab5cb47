"""Text functions on the literal cases of the reference behaviour and on Python twins."""

import re
from collections import Counter

from pyspark.sql import functions as F

from lexispark.functions import jsonrepair, text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_clean_counts_every_white_space_of_python(spark):
    raw = "  a b c\u0085d\x1ce\t\n f "
    assert one(spark, text.clean(F.col("t")), t=raw) == " ".join(raw.split())
    assert one(spark, text.clean(F.col("t")), t=None) == ""


def test_split_and_join(spark):
    assert one(spark, text.split_citations(F.col("t")), t=" Art. 1 OR ; ;BGE 1 I 2;Art. 1  OR") == ["Art. 1 OR", "BGE 1 I 2"]
    assert one(spark, text.join_list(F.col("t")), t=[" a  b", "", "c"]) == "a b ; c"


def test_views_of_a_query(spark):
    query = "Wie gilt Art. 41 OR?  Die Haftpflicht bei Unfall; Frage eins. Frage zwei."
    views = text.query_views(spark.createDataFrame([("q", query)], "query_id string, query string")).first()
    assert views["normal_query"] == views["fulltext"] == query
    assert views["citations"] == "Art. 41 OR?  Die Haftpflicht bei Unfall".replace("  ", " ")
    assert views["keywords"].startswith("Art. 41 OR? Die Haftpflicht bei Unfall frage eins ")
    meta = views["meta_searchterm"].split("; ")
    assert meta[1] == "Unfall, Haftpflicht"


def test_keyword_ranking_equals_a_plain_count(spark):
    said = "claim alpha Beta beta gamma ALPHA under delta Über über 4A_123/2020 word"
    rows = text.keyword_ranking(spark.createDataFrame([(1, said)], "id int, t string"), "id", "t").orderBy("place").collect()
    tokens = [t.lower() for t in re.findall(text.KEYWORD, said)]
    expected = Counter(t for t in tokens if t not in text.STOP_WORDS)
    assert [(r["keyword"], r["n"]) for r in rows] == sorted(expected.items(), key=lambda p: (-p[1], p[0]))


def test_citation_view_keeps_a_query_without_citations_as_it_is(spark):
    assert one(spark, text.citation_view(F.col("t")), t="  no  citation ") == "  no  citation "


def test_escape_truncate_reasoning(spark):
    assert one(spark, text.html_escape(F.col("t")), t="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, text.truncated(F.col("t"), 3), t="abcd") == "abc …[truncated]"
    assert one(spark, text.truncated(F.col("t"), 0), t="abcd") == "abcd"
    cases = {" <think> why </think> yes ": ("yes", "why", None), "plain": ("plain", None, None), "<think>open": (None, None, "truncated"), "a</think>": (None, None, "malformed"), "<think>x</think> ": (None, None, "no answer"), "<think>x</think>y<think>": (None, None, "nested")}
    for raw, want in cases.items():
        assert tuple(one(spark, text.split_reasoning(F.col("t")), t=raw)) == want


def test_credentials(spark):
    check = lambda t: one(spark, text.credential_problem(F.col("t")), t=t)
    value = "A" * 24
    assert check(f'api_key = "{value}"') and check(f"export MY_TOKEN={value}") and check("-----BEGIN PRIVATE KEY-----")
    assert not check(f'api_key = "example{value}"') and not check('password = "short"')


def test_document_rendering_skips_blank_fields(spark):
    df = spark.createDataFrame([("d1", " ", None, "raw  text")], "decision_id string, court string, title string, full_text string")
    assert df.select(text.render_document(("decision_id", "court", "title")).alias("x")).first()["x"] == "[decision_id] d1 [full_text] raw  text"


def test_json_repair():
    whole = '{"normal_query": "q", "keywords_de": ["a", "b"]}'
    assert jsonrepair.parse(f"text {whole} more") == {"normal_query": "q", "keywords_de": ["a", "b"]}
    assert jsonrepair.parse('{"normal_query": "say \\"x\\"", "keywords_de": ["a", "b", "tru') == {"normal_query": 'say "x"', "keywords_de": ["a", "b"]}
    assert jsonrepair.parse(None) == {} and jsonrepair.parse("[1]") == {}


def test_json_repair_in_spark(spark):
    df = spark.createDataFrame([('{"notes": "n", "keywords_en": ["x"]',), (None,)], "c string")
    rows = df.select(jsonrepair.repair_json("c").alias("r")).select("r.*").collect()
    assert rows[0]["notes"] == "n" and rows[0]["keywords_en"] == ["x"] and rows[1]["notes"] is None
