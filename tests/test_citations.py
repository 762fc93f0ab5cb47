"""Citation extraction and the check of answers."""

from lexispark.functions import citations as cite


def laws(text):
    return sorted(cite.law_citations(text))


def test_french_and_italian_names_of_codes_become_german_ones():
    assert laws("Selon l'art. 271 al. 1 CO et l'art. 8 CC, puis art. 29 al. 2 Cst.") == ["Art. 271 Abs. 1 OR", "Art. 29 Abs. 2 BV", "Art. 8 ZGB"]


def test_articles_before_one_code():
    assert laws("nach Art. 256, 257 und 259 OR gilt") == ["Art. 256 OR", "Art. 257 OR", "Art. 259 OR"]


def test_a_second_paragraph_also_counts_as_an_article():
    assert laws("Art. 146 Abs. 1 und 2 StGB") == ["Art. 146 Abs. 1 StGB", "Art. 146 Abs. 2 StGB", "Art. 2 StGB"]


def test_a_letter_or_first_number_implies_its_paragraph():
    assert laws("Art. 337 Abs. 2 lit. b OR") == ["Art. 337 Abs. 2 OR", "Art. 337 Abs. 2 lit. b OR"]
    assert laws("Art. 139 Ziff. 1 StGB") == ["Art. 139 Abs. 1 StGB", "Art. 139 Ziff. 1 StGB"]


def test_a_code_too_far_away_or_behind_a_semicolon_is_none():
    assert laws("Art. 31; dann ZGB") == []
    assert laws("Art. 31 " + "wort " * 140 + "ZGB") == []
    assert laws("Art. 31 Cst. gilt") == ["Art. 31 BV"]


def test_courts():
    found = cite.court_citations("Vgl. ATF 133 II 249 consid. 1.3 et 2, BGE 121 III 60 E. 3d, 4 und 5C_7/2011 E. 2.")
    assert {"BGE 133 II 249 E. 1.3", "BGE 133 II 249 E. 2", "BGE 121 III 60", "BGE 121 III 60 E. 4", "5C_7/2011", "5C_7/2011 E. 2"} <= found


def test_extraction_in_spark_skips_texts_without_citations(spark):
    df = spark.createDataFrame([(1, "art. 3 ZGB"), (2, "nothing"), (3, None)], "id int, t string")
    rows = {r["id"]: r["citations"] for r in cite.with_citations(df, "t").collect()}
    assert rows[1]["laws"] == ["Art. 3 ZGB"] and rows[2]["laws"] == [] and rows[3]["courts"] == []


def test_answers(spark):
    vocabulary = spark.createDataFrame([("Art. 1 Abs. 1 OR",), ("Art. 1 Abs. 1 lit. a OR",), ("Art. 2 OR",)], "citation string")
    accepted = ["Art. 1 Abs. 1 OR", "Art. 1 Abs. 1 lit. a OR"]
    answers = {
        "ok": "See Art. 1 Abs. 1 lit. a OR.", "outside": "See Art. 9 OR.", "refused": "See Art. 2 OR.", "inexact": "See Art. 1 al. 1 OR.", "surface": "See Art. 1 Abs. 1 OR and Art. 5 Foo.", "none": "No citation.",
    }
    df = spark.createDataFrame([(k, v, accepted) for k, v in answers.items()], "answer_id string, answer string, accepted array<string>")
    found = {r["answer_id"]: r["problem"] for r in cite.validate_answers(df, vocabulary).collect()}
    assert found == {"ok": None, "outside": "outside vocabulary", "refused": "not accepted", "inexact": "not exact", "surface": "unrecognised surface", "none": None}
