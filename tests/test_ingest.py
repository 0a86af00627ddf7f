import json

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import catalog, ingest
from tarnfold.sources import config, feed, fetch, store
from tarnfold.streaming import merge


@pytest.mark.parametrize("args, want", [
    ((False, False, 3, 0, True, True, 0), ("unsupported", False, False)),
    ((True, True, 0, 0, True, True, 0), ("encrypted", False, False)),
    ((True, False, 3, 0, True, True, 0), ("text-layer", False, False)),
    ((True, False, 0, 2, False, True, 0), ("none", True, False)),
    ((True, False, 1, 2, True, False, 0), ("text-layer", True, False)),
    ((True, False, 0, 2, True, True, 50), ("ocr", False, False)),
    ((True, False, 1, 12, True, True, 50), ("text-layer+ocr", False, True)),
    ((True, False, 0, 2, True, True, 0), ("none", False, False)),
])
def test_extraction(spark, args, want):
    x = spark.range(1).select(ingest.extraction(*map(F.lit, args)).alias("x")).first().x
    assert (x.method, x.ocr_pending, x.truncated) == want


def test_runs_on_one_baseline_join_with_one_blank(spark):
    runs = [("d", 1, 10.0, 100.2, 5.0, "Board"), ("d", 1, 17.0, 100.1, 9.0, "room"), ("d", 1, 26.5, 100.0, 3.0, "s"), ("d", 1, 10.0, 90.0, 4.0, "  "), ("d", 1, 12.0, 120.0, 4.0, "top"), ("d", 2, 1.0, 1.0, 1.0, "")]
    df = spark.createDataFrame(runs, "doc string, page int, x double, y double, width double, str string")
    assert [tuple(r) for r in ingest.runs_to_lines(df, "doc").collect()] == [("d", 1, "top\nBoard rooms")]


def test_a_failure_never_replaces_good_data(spark):
    cols = "k long, value string, failed string, first_seen long"
    new = spark.createDataFrame([(1, None, "HTTP 500", 9), (2, "b2", None, 9), (3, None, "x", 9), (4, None, "y", 9)], cols)
    old = spark.createDataFrame([(1, "a1", None, 1), (2, None, "z", 2), (3, None, "w", 3), (5, "e", None, 5)], cols)
    got = {r.k: (r.value, r.failed, r.first_seen) for r in ingest.keep_good(new, old, "k").collect()}
    assert got == {1: ("a1", None, 1), 2: ("b2", None, 2), 3: (None, "x", 3), 4: (None, "y", 9), 5: ("e", None, 5)}


def test_refs_must_be_unique(spark):
    with pytest.raises(ValueError, match="f1"):
        catalog.unique_refs(spark.createDataFrame([("f1",), ("f1",), ("f2",)], "ref string"))
    assert catalog.unique_refs(spark.createDataFrame([("f1",), ("f2",)], "ref string")).count() == 2


def test_state_round_trip_and_migration(spark, tmp_path):
    p = str(tmp_path / "state")
    assert [x.count() for x in store.load_state(spark, p, "9")] == [0, 0]
    docs = spark.createDataFrame([("1", "h", 5, 0, 1, "none", None, None, None, None, None)], store.STATE_DOCUMENTS)
    meetings = spark.createDataFrame([("m", "h", None, 1, True, None)], store.STATE_MEETINGS)
    store.save_state(p, "9", meetings, docs)
    store.save_state(p, "9", *store.load_state(spark, p, "9"))  # over what it reads
    assert [x.count() for x in store.load_state(spark, p, "9")] == [1, 1]
    assert [x.count() for x in store.load_state(spark, p, "8")] == [0, 0]
    spark.createDataFrame([(2, "9")], "version int, org string").write.mode("overwrite").parquet(f"{store.Versions(spark, p).folder()}/about")
    assert store.load_state(spark, p, "9")[1].first().ocr_pending is True


def test_a_run_that_stops_anywhere_leaves_the_state_before_it(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "state")
    docs = lambda n: spark.createDataFrame([(str(i), "h", 5, 0, 1, "none", None, None, None, None, None) for i in range(n)], store.STATE_DOCUMENTS)
    meetings = spark.createDataFrame([], store.STATE_MEETINGS)
    store.save_state(p, "9", meetings, docs(1))
    writer = type(meetings.write)
    parquet = writer.parquet
    for stop_at in range(4):
        steps = iter(range(10))

        def stopping(self, path, *args, steps=steps, stop_at=stop_at, **kwargs):
            if next(steps) == stop_at:
                raise KeyboardInterrupt
            parquet(self, path, *args, **kwargs)

        with monkeypatch.context() as m:
            m.setattr(writer, "parquet", stopping)
            if stop_at == 3:  # all is written but the marker
                m.setattr(store, "MARKER", "_ELSE")
                store.save_state(p, "9", meetings, docs(2))
            else:
                with pytest.raises(KeyboardInterrupt):
                    store.save_state(p, "9", meetings, docs(2))
        assert store.load_state(spark, p, "9")[1].count() == 1
    store.save_state(p, "9", meetings, docs(3))
    assert store.load_state(spark, p, "9")[1].count() == 3


def test_a_ref_that_occurs_twice_keeps_the_documents_that_were_there(spark, tmp_path):
    p = str(tmp_path / "documents")
    assert store.read_table(spark, p) is None
    store.save_documents(spark.createDataFrame([("f1",), ("f2",)], "ref string"), p)
    with pytest.raises(ValueError, match="f3"):
        store.save_documents(spark.createDataFrame([("f3",), ("f3",)], "ref string"), p)
    assert sorted(r.ref for r in store.read_table(spark, p).collect()) == ["f1", "f2"]
    store.replace_table(store.read_table(spark, p).where("ref = 'f1'"), p)  # over what it reads
    assert [r.ref for r in store.read_table(spark, p).collect()] == ["f1"]


def test_rows_as_json_and_reports(spark, tmp_path):
    store.write_json(spark.createDataFrame([(1, "x\ny{"), (2, None)], "a int, b string"), f"{tmp_path}/j")
    assert sorted(map(tuple, store.read_json(spark, f"{tmp_path}/j", "a int, b string").collect())) == [(1, "x\ny{"), (2, None)]
    d = spark.createDataFrame([("minutes", "abc"), ("minutes", ""), ("attachment", None)], "kind string, text string")
    m = spark.createDataFrame([(2020, "2020-01-02", True, False), (2021, "2021-01-02", False, True)], "year int, date string, docs_indexed boolean, cancelled boolean")
    told = catalog.report(d, m).splitlines()
    assert told[0] == "Meetings    2 (1 with documents, 1 cancelled), 2020-01-02 to 2021-01-02" and len(told) == 5 and told[3].startswith("2021")


def test_texts_binaries_json(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/minutes-1.txt").write_text("a\nb")
    (tmp_path / "t/big.bin").write_bytes(b"x" * 100)
    texts = store.read_texts(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in texts.collect()] == [("minutes-1", "a\nb")]
    wanted = spark.createDataFrame([("minutes-1",), ("2",)], "key string")
    assert {r.key: r.text for r in store.texts_for(wanted, texts, "key").collect()} == {"minutes-1": "a\nb", "2": None}
    assert store.with_text(wanted, texts, "key").count() == 1
    assert store.read_texts(spark, str(tmp_path / "none")).count() == 0
    files = {r.bytes: (r.content, r.failed) for r in store.read_binaries(spark, str(tmp_path / "t"), 10).collect()}
    assert bytes(files[3][0]) == b"a\nb" and files[100] == (None, "too-large")
    (tmp_path / "m.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "bad.json").write_text("{nope")
    assert store.read_json(spark, str(tmp_path / "m.json"), "a int").count() == 2
    assert store.read_json(spark, str(tmp_path / "bad.json"), "a int").count() == 0
    assert store.read_json(spark, str(tmp_path / "missing.json"), "a int").count() == 0
    assert not store.ocr_available(lambda tool: None) and store.ocr_available(lambda tool: "/bin/x")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 7, i * 3 % 11, f"v{i}") for i in range(60)]
    schema = "n long, k long, at long, v string"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = merge.start(read, f"{tmp_path}/table", f"{tmp_path}/check", "k", "at")
    q.awaitTermination(120)
    got = merge.current(spark, f"{tmp_path}/table")
    assert {r.k for r in got.collect()} == set(range(7)) and got.count() == 7
    assert len(merge.versions(spark, f"{tmp_path}/table")) == 2
    again = spark.createDataFrame([(99, 3, 50, "new"), (98, 100, 1, "other")], schema)
    for batch in (7, 7, 0):  # a batch that runs twice, and a stream without its checkpoint
        merge.merge_into(f"{tmp_path}/table", "k", "at", buckets=5)(again, batch)
        now = {r.k: r.v for r in merge.current(spark, f"{tmp_path}/table").collect()}
        assert now.keys() == {*range(7), 100} and now[3] == "new" and now[100] == "other"
    done = merge.run_within(merge.start(read, f"{tmp_path}/table", f"{tmp_path}/check", "k", "at"), 60)
    assert done and merge.current(spark, f"{tmp_path}/table").count() == 8


def test_a_budget_ends_a_stream_without_harm(spark, tmp_path):
    for part in range(6):
        spark.createDataFrame([(part, part, 1, "v")], "n long, k long, at long, v string").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    read = lambda: spark.readStream.schema("n long, k long, at long, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    begin = lambda: merge.start(read(), f"{tmp_path}/table", f"{tmp_path}/check", "k", "at")
    assert not merge.run_within(begin(), 0)
    for _ in range(10):
        if merge.run_within(begin(), 30):
            break
    assert merge.current(spark, f"{tmp_path}/table").count() == 6


def test_feed(spark):
    rows = [("f1", "Bell\x07 <schedule>", "attachment", "https://x/?a&b", "5.A.", "2026-08-01 10:00:00", "2026-08-03", "Business Meeting"), ("m2", "M", "minutes", "u", None, "not a date", None, "")]
    df = spark.createDataFrame(rows, "ref string, title string, kind string, source_url string, item_label string, first_seen string, date string, meeting_name string")
    now = F.lit("2026-09-09 00:00:00").cast("timestamp")
    xml = feed.atom(df, "77", "T & x", "sub", "https://s/", now)
    assert "<title>Bell &lt;schedule&gt;</title>" in xml and 'href="https://x/?a&amp;b"' in xml and "urn:documents:77:f1" in xml
    assert "<summary>Business Meeting · 2026-08-03 · item 5.A.</summary>" in xml and xml.count("<entry>") == 2
    assert "<updated>2026-08-01T10:00:00.000Z</updated>" in xml and xml.count("2026-09-09T00:00:00.000Z") == 2
    import xml.etree.ElementTree as et

    et.fromstring(xml.encode())
    empty = feed.atom(df.limit(0), "77", "T", now=now)
    assert "<entry>" not in empty and 'href=""' not in empty and "<id>urn:documents:77</id>" in empty


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"org_id": "9", "org_name": "Org", "base_url": "https://x/"}))
    c = config.load(str(p), {"TARNFOLD_DELAY_MS": "5", "TARNFOLD_OCR": "1"})
    assert (c.base_url, c.request_delay_ms, c.ocr_enabled, c.title) == ("https://x", 5, True, "Org Document Search")
    p.write_text(json.dumps({"org_id": "9", "org_name": "Org", "base_url": "", "x": 1}))
    with pytest.raises(ValueError, match="unknown"):
        config.load(str(p), {})


def test_fetching_rules():
    slept = []
    gate = fetch.Gate(1.0, clock=lambda: 0.0, sleep=slept.append)
    answers = iter([(503, {"Retry-After": "7"}, b""), (429, {}, b""), (200, {"Content-Type": "text/html", "Content-Length": "2"}, b"ok")])
    got = fetch.polite(lambda: next(answers), gate, 3, expect="html")
    assert got["body"] == b"ok" and got["failed"] is None
    assert slept == [7.0, 1.0, 3.0, 2.0]
    assert fetch.polite(lambda: (404, {}, b""), gate, 3)["failed"] == "HTTP 404"
    assert fetch.polite(lambda: (200, {"content-length": "99"}, b"x"), gate, 0, most_bytes=5)["failed"] == "too-large"
    assert fetch.polite(lambda: (200, {}, b"x" * 9), gate, 0, most_bytes=5)["bytes"] == 9
    assert "2 attempts" in fetch.polite(lambda: (500, {}, b""), gate, 1)["failed"]
    assert [fetch.wait_before_retry(n) for n in (0, 1, 9)] == [1.5, 3.0, 30.0]
