import pytest

import corpus_pipeline
from tarnfold.llm import simhash, toxicity


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, odd_rows):
    from test_toxicity import corpus

    d = tmp_path_factory.mktemp("sf")
    rows = corpus(400, 2)
    docs = [(i, t + f"\nthis line stands in every text of the lot", "en", f"s{i % 3}", 1) for i, t, _ in rows] + [(1000 + i, t, "en", "s1", 1) for i, t, y in rows[:40] if not y]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), {i: y for i, _, y in rows}


def test_stages_take_effect_in_order(spark, sf, tmp_path):
    d, toxic = sf
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "source_mixing", "packing"]
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {r.doc_id for r in seen["toxicity"]}
    clean = {i for i, y in toxic.items() if not y}
    assert len(clean - ids) <= 0.01 * len(clean) and len(ids - clean - {i for i in ids if i >= 1000}) <= 0.03 * len(toxic)
    held = [r for r in seen["line_dedup"] if "this line stands in every text" in r.text]
    assert [r.doc_id for r in held] == [max(i for i in ids if i < 1000)]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"] if r.doc_id < 1000 and r not in held)
    assert len(seen["line_dedup"]) == len(seen["toxicity"])
    left = {r.doc_id for r in seen["near_duplicates"]}
    assert len(left) == len(seen["near_duplicates"]) and not {i for i in left if i >= 1000 and i - 1000 in left}
    assert {r.doc_id for r in seen["source_mixing"]} <= left
    copies = {}
    for r in seen["source_mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies.values()) <= {1, 2}
    assert {r.doc_id for r in seen["packing"]} == set(copies)


def test_run_equals_the_stages(spark, sf):
    d, _ = sf
    a, b = (sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, d).collect()) for _ in range(2))
    assert a == b and a


def test_stages_on_odd_and_empty_tables(spark, sf, odd_docs, no_docs, tmp_path):
    d, _ = sf
    for at, docs in enumerate((odd_docs, no_docs)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, d).write.parquet(f"{tmp_path}/{at}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{at}-{k}")
    assert docs.count() == 0
    assert simhash.keep_one(no_docs).columns == no_docs.columns and toxicity.drop_toxic(no_docs, None).count() == 0
