"""The match layer against SQLite's own full-text engine."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tarnfold.functions.tokens import tokens, tokens_of
from tarnfold.operators import search
from tarnfold.operators.index import Index, build, document_frequencies
from tarnfold.operators.match import hits, matches, ranked
from tarnfold.operators.snippet import snippet
from tarnfold.plans.query_lang import Request, compile_query

WORDS = "bond levy school bus Bürgermeister naïve don't 6.A.1. budget report board Łódź Ærø straße 2024 x_y café of the vote".split()


def corpus():
    rnd = random.Random(11)
    make = lambda a, b: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(a, b)))
    rows = [(i, make(1, 4), make(0, 3), rnd.choice([None, "Ann Lee", "Bo Levy"]), make(0, 60)) for i in range(150)]
    return rows + [(150, None, None, None, None), (151, "", "", "", ""), (152, "été BOND", "school\nbus", "", "the the the bond")]


@pytest.fixture(scope="module")
def sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, item_title, presenter, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, title, item_title, presenter, text) VALUES (?,?,?,?,?)", corpus())
    return con


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, title string, item_title string, presenter string, text string")
    return build(docs).cached()


QUERIES = ["bond", "BOND levy", "bond OR levy", '"school bus"', '"school bus"*', "bo*", "title:bond", "title:bo*", "presenter:levy", "bond -levy", '"the board" OR vote -title:"school bus" -budget', "don't", "6.A.1.", "naive", "NAÏVE", "Łódź", "lodz", "strasse", "straße", "aero", "ærø",
           "x_y", "2024", '"of the" vote', "bond bond", '"the the"', "the", "zzz", "& bond", "bond OR &", "bond -&", "été", "item_title:bus bond*", '"bond levy school"', "cafe OR caf*"]


@pytest.mark.parametrize("raw", QUERIES)
@pytest.mark.parametrize("relaxed", [False, True])
def test_matches_and_ranks_like_sqlite(index, sqlite, raw, relaxed):
    plan = compile_query(raw, relaxed)
    want = dict(sqlite.execute("SELECT rowid, bm25(f, 8.0, 5.0, 0.3, 1.5) FROM f WHERE f MATCH ?", (plan.expr,)).fetchall())
    got = {r.doc_id: r["rank"] for r in ranked(index, plan).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_tokens_like_sqlite(spark, sqlite):
    rows = [r[4] for r in corpus() if r[4]] + ["Ünï-cödé fi ½ ²  Ⅷ ǅ", "ạ́b", "日本語 テスト", "x​y", "ПРИВЕТ Ёлка"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(tokens(F.col("t"))).collect()]
    assert got == [tokens_of(t) for t in rows]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(rows[:-5]))
    want = {}
    for term, doc, _, _ in con.execute("SELECT term, doc, col, offset FROM v ORDER BY doc, offset"):
        want.setdefault(doc, []).append(term)
    assert [want.get(i, []) for i in range(len(rows) - 5)] == got[:-5]


def test_properties(index):
    ids = lambda raw, relaxed=False: {r.doc_id for r in matches(index, compile_query(raw, relaxed)).collect()}
    assert ids("bond levy") <= ids("bond levy", True)
    assert not ids("bond -levy") & ids("levy")
    assert ids("bo*") >= ids("bond") | ids("board")
    assert ids('"school bus"') <= ids("school bus")


def test_written_index_gives_the_same(index, spark, tmp_path):
    index.write(str(tmp_path / "i"))
    back = Index.read(spark, str(tmp_path / "i"))
    for raw in ('"of the" vote', "bo*"):
        plan = compile_query(raw)
        assert sorted(ranked(back, plan).collect()) == sorted(ranked(index, plan).collect())
    assert (back.n_docs, back.avg_len) == (index.n_docs, index.avg_len)
    assert document_frequencies(back).where("term = 'bond'").first().df == len({r.doc_id for r in hits(back, list(compile_query("bond").used)).collect()})


def test_no_terms_and_empty_index(spark):
    empty = build(spark.createDataFrame([], "doc_id long, title string, item_title string, presenter string, text string"))
    assert ranked(empty, compile_query("bond")).collect() == []
    assert ranked(empty, compile_query("&")).collect() == []


@pytest.fixture(scope="module")
def library(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, title string, item_title string, presenter string, text string").selectExpr("*", "doc_id % 40 as meeting_id", "case when doc_id % 2 = 0 then 'minutes' else 'attachment' end as kind", "concat('f', doc_id) as ref")
    meetings = spark.range(40).selectExpr("id as meeting_id", "case when id % 10 > 0 then concat(2000 + id % 4, '-01-0', id % 9 + 1) end as date", "case when id % 10 > 0 then cast(2000 + id % 4 as int) end as year", "concat('Meeting ', id) as meeting_name")
    meetings = meetings.where("meeting_id <> 39")
    return search.Library(docs, meetings, build(search.with_facts(docs, meetings)).cached())


@pytest.mark.parametrize("sort", ["rank", "newest", "oldest"])
def test_pages_join_to_the_full_order(library, sort):
    request, plan = Request("bond", sort=sort), compile_query("bond")
    n = search.count_matches(library, plan, request).first().n
    pages = [r.doc_id for at in range(0, n, 7) for r in search.page(library, plan, request, at, 7).collect()]
    assert len(pages) == n == len(set(pages))
    assert pages == [r.doc_id for r in search.page(library, plan, request, 0, n).collect()]


def test_search_relaxes_and_keeps_its_plan(library):
    rows, told = search.search(library, Request("zzz bond levy"))
    assert told["relaxed"] and told["total"] > 25 and told["more"] and rows.count() == 25
    rows2, told2 = search.search(library, Request("zzz bond levy"), offset=25, plan=told["plan"])
    assert told2["total"] == told["total"] and not {r.doc_id for r in rows.collect()} & {r.doc_id for r in rows2.collect()}
    assert all("\x01" in (r.snip + r.tsnip + (r.isnip or "")) for r in rows.where("snip is not null").collect())
    none, told = search.search(library, Request("-levy"))
    assert none is None and told["message"].startswith("Add at least")


def test_a_search_equals_its_parts(library):
    for request in (Request("bond"), Request("zzz bond levy", sort="newest"), Request("bond -levy", 2001, "attachment")):
        rows, told = search.search(library, request)
        plan, n = search.choose_plan(library, request)
        assert (told["plan"], told["total"]) == (plan, n) and n == search.count_matches(library, plan, request).first().n
        assert rows.collect() == search.full_page(library, plan, request).collect()
        assert all(r.meeting_id != 39 for r in search.results(library, plan, request).collect())


def test_a_ranked_search_reads_the_postings_once_and_joins_nothing(library, spark, tmp_path):
    library.index.write(str(tmp_path / "plan"))
    written = search.Library(library.documents, library.meetings, Index.read(spark, str(tmp_path / "plan")))
    rows = search.page(written, compile_query('bond "school bus" -levy'))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(f"{kind}Join" in plan for kind in ("SortMerge", "BroadcastHash", "ShuffledHash", "NestedLoop")) and "ReusedExchange" in plan
    assert "PushedFilters: [Or" in plan


def test_filters_do_not_change_ranks(library):
    plan = compile_query("bond")
    every = {r.doc_id: r["rank"] for r in search.results(library, plan).collect()}
    some = search.results(library, plan, Request(year=2001, kind="attachment")).collect()
    assert some and all(r.year == 2001 and r.kind == "attachment" and every[r.doc_id] == r["rank"] for r in some)


MARK = ("[", "]")


@pytest.mark.parametrize("text, terms, n, want", [
    ("one two three", [(["two"], False)], 10, "one [two] three"),
    ("no match in here at all", [(["zzz"], False)], 3, "no match in…"),
    ("École buses, school bus!", [(["school", "bus"], False)], 9, "École buses, [school bus]!"),
    ("Été ecole", [(["ete"], False), (["ec"], True)], 5, "[Été] [ecole]"),
    ("", [(["a"], False)], 5, ""),
    (None, [(["a"], False)], 5, None),
])
def test_snippets(text, terms, n, want):
    assert snippet(text, terms, n, MARK) == want


def test_snippets_like_sqlite():
    """Random texts with sentences, phrases, prefixes and repeats: the window and the marks that the engine itself gives."""
    rnd = random.Random(21)
    words, ends = "ab ac b ba c d e f g h bond bus é".split(), [" ", " ", " ", ". ", ": ", ".", ", ", "\n", ".\n", " - "]
    terms = ["ab", "b", "bond", '"a b"', '"b c"', '"c b a"', "b*", '"b b"', "é", "d", "g", "h"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    texts = ["".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(1, 70))) for _ in range(400)]
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", enumerate(texts))
    seen = 0
    for _ in range(60):
        raw = " OR ".join(rnd.sample(terms, rnd.randint(1, 4)))
        plan = compile_query(raw)
        wanted = [(t.tokens(), t.prefix) for t in plan.used]
        n = rnd.choice([3, 5, 8, 22])
        for i, want in con.execute(f"SELECT rowid, snippet(f, 0, '[', ']', '…', {n}) FROM f WHERE f MATCH ?", (plan.expr,)).fetchall():
            assert snippet(texts[i], wanted, n, MARK) == want, (texts[i], plan.expr, n)
            seen += 1
    assert seen > 5000
