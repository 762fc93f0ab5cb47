"""The corpus pipeline: stage by stage against plain versions."""

import corpus_pipeline as pipeline

from .helpers import SCHEMA, corpus, plain
from .test_dedup import exact_twin, near_twin
from .test_mixing_sharding import twin


def test_stages_keep_columns_and_decide(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = plain(docs)
    stage = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe"]

    def step(name, docs):
        path = str(tmp_path / name)
        stage[name](spark, docs, str(tmp_path)).write.parquet(path)
        return spark.read.parquet(path)

    known = step("language_id", docs)
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in known.collect()} == set(texts) - {52, 53, 54}
    single = step("exact_dedup", known)
    left = plain(known)
    assert set(plain(single)) == {k for k, _ in exact_twin(left).values()}
    near = step("near_dedup", single)
    assert set(plain(near)) == {c for _, c in near_twin(plain(single), 5).values()} and near.columns == docs.columns
    mixed = step("mix_sources", near)
    _, size, copies = twin(near.collect())
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(d for d, n in copies.items() for _ in range(n if size[d] else 1))
    last = step("bpe", mixed).collect()
    whole = pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r["doc_id"], r["n_tokens"], tuple(r["token_ids"]), r["decoded_sha256"]) for r in rows)
    assert key(last) == key(whole) and len(last) == mixed.count()


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls everywhere, repeated rows, and columns named like those that operators use inside."""
    docs = corpus(spark)
    odd = docs.selectExpr("*", "'a' as lang_pred", "'b' as file", "1 as at", "2 as row", "'c' as __doc", "3 as __sk", "4 as gone", "5 as __copies", "6 as __i", "7 as node", "8 as digest", "9 as part")
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "the house and the garden of the city are old", None, None, 1)] * 2, SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        got = stage(spark, odd, str(tmp_path))
        rows = got.collect()
        if name != "bpe":
            assert got.columns == odd.columns and {(r["lang_pred"], r["row"], r["__doc"], r["part"]) for r in rows} == {("a", 2, "c", 9)}, name
        assert len(rows) >= 40, name
        stay = stage(spark, nulls, str(tmp_path)).count()
        assert stay == {"language_id": 0, "exact_dedup": 2, "near_dedup": 5, "mix_sources": 5, "bpe": 5}[name], (name, stay)
