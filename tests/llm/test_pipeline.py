"""The pipeline's stages, each against what its operator decides on the stage's own input."""
from __future__ import annotations

from gapscope.llm import neardup, secrets, toxicity
from gapscope.llm.common import prepare, table

from .test_operators import SF, check_packing, groups_by_force


def test_stages_in_order(spark, tmp_path):
    import corpus_pipeline as pipeline
    from gapscope.llm import tokens

    prepare(spark)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = table(spark, SF, "documents")
    columns, inputs = docs.columns, {}
    for name, stage in pipeline.STAGES:
        inputs[name] = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    texts = {i: r.text or "" for i, r in inputs["near_duplicates"].items()}
    want = {i for i, (_, _, kept) in groups_by_force(texts, 5, 80, 100).items() if kept}
    assert set(inputs["decontamination"]) == want
    assert all(inputs["near_duplicates"][i] == inputs["decontamination"][i] for i in want)
    patterns = secrets.compiled()
    for i, r in inputs["secrets"].items():
        after = inputs["packing"][i]
        spans = secrets.base_spans(r.text, patterns) + secrets.structural_spans(r.text, patterns)
        assert after.text == (secrets.redact(r.text, spans) if spans else r.text) and after.n_chars == len(after.text)
    full = tokens.worker_tokenizer().full
    check_packing(docs.collect(), {i: full.encode(r.text, add_special_tokens=False).ids + [2] for i, r in inputs["packing"].items()})


def test_toxic_rows_go_and_clean_rows_stay(spark):
    prepare(spark)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.learn(docs, labels)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}


def test_keep_one_matches_groups(spark):
    prepare(spark)
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == {r.doc_id for r in neardup.link_groups(docs).collect() if r.kept}
