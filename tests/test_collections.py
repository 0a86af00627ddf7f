import pytest
from pyspark.sql import functions as F

from tarnfold.operators import collections as c


def run(spark, refs, f):
    return spark.createDataFrame([(refs,)], "r array<string>").select(f(F.col("r")).alias("x")).first().x


def test_toggle(spark):
    on = run(spark, ["f1"], lambda r: c.toggle(r, F.lit("f2")))
    assert (on.stars, on.starred, on.full) == (["f1", "f2"], True, False)
    off = run(spark, ["f1", "f2"], lambda r: c.toggle(r, F.lit("f1")))
    assert (off.stars, off.starred, off.full) == (["f2"], False, False)
    full = [f"f{i}" for i in range(500)]
    no = run(spark, full, lambda r: c.toggle(r, F.lit("f500")))
    assert (no.stars, no.starred, no.full) == (full, False, True)
    for bad in ("781", "../x", ""):
        assert not run(spark, [], lambda r, bad=bad: c.toggle(r, F.lit(bad))).starred


def test_clean_save_load(spark):
    assert run(spark, ["f1", "f1", "f2", "x", None, "i3\n"], c.clean) == ["f1", "f2"]
    assert run(spark, None, c.clean) == []
    assert run(spark, ["f1", "m2"], lambda r: c.load(c.save(r))) == ["f1", "m2"]
    for bad in ("{", '{"a":1}', "7", "", None):
        assert spark.createDataFrame([(bad,)], "j string").select(c.load(F.col("j"))).first()[0] == []


def test_share(spark):
    refs = [f"{'fim'[i % 3]}{i * 37}" for i in range(200)]
    shared = run(spark, [*refs, "bogus"], c.encode)
    assert not set("+/= \n") & set(shared)
    assert run(spark, refs, lambda r: c.decode(c.encode(r))) == refs
    for bad in ("@@@", "a", "", None, "Zm9v", "w6k"):
        assert spark.createDataFrame([(bad,)], "j string").select(c.decode(F.col("j"))).first()[0] == []


@pytest.mark.parametrize("own, new, stars, added", [(["f1", "f2"], ["f2", "f3", "bogus"], ["f1", "f2", "f3"], 1), ([], ["f1", "f1"], ["f1"], 1), ([f"f{i}" for i in range(499)], ["i1", "i2"], [f"f{i}" for i in range(499)] + ["i1"], 1)])
def test_merge(spark, own, new, stars, added):
    x = run(spark, own, lambda r: c.merge(r, F.array(*map(F.lit, new))))
    assert (x.stars, x.added) == (stars, added)


def test_all_starred_documents_count(spark):
    refs = spark.range(700).selectExpr("concat('f', id) as ref")
    documents = refs.selectExpr("ref", "1 as meeting_id", "1 as sort_order")
    meetings = spark.createDataFrame([(1, "2020-01-01")], "meeting_id int, date string")
    assert c.documents_of(refs, documents, meetings).count() == 700 and c.missing(refs, documents).first().missing == 0
    assert run(spark, ["f1"], c.cleared) == [] and run(spark, None, c.cleared) == []
