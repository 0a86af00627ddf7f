"""Extra columns with any name that a module uses inside pass through every stage of the pipeline unchanged."""

import ast
import inspect

import pytest

import corpus_pipeline
from tarnfold.llm import common, components, linededup, mixing, packing, simhash, toxicity

MODULES = (common, components, linededup, mixing, packing, simhash, toxicity, corpus_pipeline)
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def names_in(module):
    """Every string of the code that could be a column's name."""
    found = (n.value for n in ast.walk(ast.parse(inspect.getsource(module))) if isinstance(n, ast.Constant) and isinstance(n.value, str))
    return {s for s in found if s.isidentifier() and len(s) < 30}


def test_every_internal_name_as_an_extra_column(spark, tmp_path_factory, odd_rows):
    extra = sorted({n.lower(): n for m in MODULES for n in names_in(m)}.keys() - set(OWN))
    assert {"ld_text", "ld_id2", "near_hash", "near_rank", "keep_id", "mix_copies", "mix_copy", "mix_source", "mix_rate", "tox_id"} <= set(extra)
    d = str(tmp_path_factory.mktemp("clash"))
    texts = [r[:5] for r in odd_rows if len(r[1] or "") < 10_000]
    texts += [(100 + i, f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(30)) + "\nthis line is in every one of them", "en", "s1", 9) for i in range(30)]
    value = lambda r, n: f"{n} of {r[0]}"
    rows = [(*r, *[value(r, n) for n in extra]) for r in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in extra)
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    plain = docs.select(*OWN)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, bare = stage(spark, docs, d), stage(spark, plain, d)
        if name == "packing":
            assert sorted(map(tuple, out.select("doc_id", "piece", "length", "ids_crc32").collect()), key=str) == sorted(map(tuple, bare.select("doc_id", "piece", "length", "ids_crc32").collect()), key=str)
            break
        assert out.columns == docs.columns
        rows = out.collect()
        assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(map(tuple, bare.collect()), key=str)
        assert all(r[n] == value(r, n) for r in rows for n in extra)
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        plain = docs.select(*OWN)


@pytest.mark.parametrize("names", [("a", "A_"), ("x y", "b.c")])
def test_names_that_are_taken_give_way(spark, names):
    df = spark.createDataFrame([(1, 2)], list(names))
    assert common.fresh(df, "a", "a", "b") == (["a__", "a___", "b"] if "a" in names else ["a", "a_", "b"])
    assert df.select(*common.own_columns(df)).columns == list(names)
