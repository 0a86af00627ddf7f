import hashlib

import pytest

from tarnfold.llm import linededup

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UP, LOW))
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs.setdefault(key(line), set()).add(i)
    stays = {k: max((x for x in v if x is not None), default=None) for k, v in docs.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in stays or stays[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(odd_docs, odd_rows):
    got = sorted(map(tuple, linededup.op8_line_dedup(odd_docs).collect()), key=str)
    assert got == brute([r[:2] for r in odd_rows])


@pytest.mark.parametrize("least", [1000, 50, 0])
def test_hot_line_in_every_document(spark, monkeypatch, least):
    monkeypatch.setattr(linededup, "HOT_LEAST", least)
    rows = [(i, f"the very common line of all\nown line number {i % 50} is shared by some\n\n{'Tail of text, twenty+' if i % 2 else 'x'}\nthe very COMMON line of all") for i in range(400)]
    got = linededup.op8_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_texts_and_columns(spark, odd_docs):
    docs = spark.createDataFrame([(i, "keep\nthis line is in all three\nend", "a") for i in range(3)], "doc_id long, text string, h1 string")
    out = {r.doc_id: r.ld_kept for r in linededup.drop_lines(docs).collect()}
    assert out == {0: "keep\nend", 1: "keep\nend", 2: "keep\nthis line is in all three\nend"}
    assert linededup.drop_lines(odd_docs).columns == [*odd_docs.columns, "ld_lines", "ld_dropped", "ld_kept"]


def test_empty_table(no_docs):
    assert linededup.op8_line_dedup(no_docs).collect() == []
