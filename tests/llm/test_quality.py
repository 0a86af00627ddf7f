import re
from collections import Counter

from tarnfold.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base_failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base_failed


def test_measures_equal_brute_force(odd_docs, odd_rows):
    got = quality.op1_quality_rules(odd_docs).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, *[r[c] for c in cols]) for r in got), key=key) == sorted(((r[0], *brute(r[1])) for r in odd_rows), key=key)
    assert not any(r.kept for r in got if r.base_failed)


def test_rules_decide_and_name_what_is_broken(spark):
    good = " ".join(f"the word{i} of thing{i}" for i in range(30))
    rows = [(1, good), (2, good.replace("the ", "").replace("of ", "")), (3, " ".join(f"the {i} #$%" for i in range(40))), (4, "the end")]
    got = {r.doc_id: r for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].broken_rules == []
    assert not got[2].kept and got[2].broken_rules == ["has function words"]
    assert "few symbols" in got[3].broken_rules
    assert got[4].base_failed and "enough words" in got[4].broken_rules


def test_own_thresholds_and_empty_table(no_docs, odd_docs):
    assert quality.op1_quality_rules(no_docs).collect() == []
    all_in = quality.apply_rules(odd_docs, rules=(), base_rules=())
    assert all_in.where("kept").count() == odd_docs.count()


def test_plan_has_no_shuffle_and_no_python(odd_docs):
    plan = quality.op1_quality_rules(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
