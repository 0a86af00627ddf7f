"""Snippets: the window of a field's tokens that shows most of the query, with its matches marked.

Windows are rated as SQLite's full-text engine rates them: a thousand for each different term that begins in it and one
for each further occurrence. A window stands so that its occurrences are in the middle, or begins with a sentence, which is
worth a hundred (120 at the text's head); the first of the best wins. A field without a match gives its head, null
gives null. What is cut off on a side shows as an ellipsis. Run on the rows that a limit left.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.markup import CLOSE, OPEN
from tarnfold.functions.tokens import RAW_RUN, fold_text
from tarnfold.plans.query_lang import FIELDS, Term
from tarnfold.shipping import ship

ELLIPSIS = "…"
LENGTHS = {"title": 40, "item_title": 24, "presenter": 24, "text": 22}
_RUN = regex.compile(RAW_RUN)


def spans_of(words: list[str], terms: list[tuple[list[str], bool]]) -> list[tuple[int, int, int]]:
    """(first token, after the last token, term) of each occurrence, by first token and term."""
    out = []
    for no, (ts, prefix) in enumerate(terms):
        for i in range(len(words) - len(ts) + 1 if ts else 0):
            *head, last = zip(words[i : i + len(ts)], ts)
            if all(a == b for a, b in head) and (last[0].startswith(last[1]) if prefix else last[0] == last[1]):
                out.append((i, i + len(ts), no))
    return sorted(out, key=lambda span: (span[0], span[2]))


def sentences(text: str, at: list[tuple[int, int]]) -> list[int]:
    """The tokens that begin a sentence: the first, and those behind white space that a full stop or a colon precedes."""
    starts = []
    for i, (begin, _) in enumerate(at):
        before = text[at[i - 1][1] : begin] if i else ""
        bare = before.rstrip(" \t\n\r")
        if not i or (bare != before and bare[-1:] in (".", ":")):
            starts.append(i)
    return starts


def best_window(found: list[tuple[int, int, int]], n_words: int, starts: list[int], n: int) -> int:
    """The first token of the window of n that rates best."""
    firsts = [f[0] for f in found]

    def inside(at: int) -> list[tuple[int, int, int]]:
        return found[bisect_left(firsts, at) : bisect_left(firsts, at + n)]

    def rate(spans: list[tuple[int, int, int]]) -> int:
        different = len({no for _, _, no in spans})
        return 1000 * different + len(spans) - different

    best, where = 0, 0
    for at in firsts:
        spans = inside(at)
        if rate(spans) > best:
            first, last = spans[0][0], spans[-1][1]
            room = n - (last - first)
            middle = first - (room // 2 if room >= 0 else -(-room // 2))
            best, where = rate(spans), max(0, min(middle, n_words - n))
        if n_words > n:
            sentence = starts[bisect_right(starts, at) - 1]
            rated = rate(inside(sentence)) + (100 if sentence else 120)
            if sentence < at and rated > best:
                best, where = rated, sentence
    return where


def snippet(text: str | None, terms: list[tuple[list[str], bool]], n: int, marks: tuple[str, str] = (OPEN, CLOSE), ellipsis: str = ELLIPSIS) -> str | None:
    if text is None:
        return None
    at = [m.span() for m in _RUN.finditer(text)]
    found = spans_of([fold_text(text[a:b]) for a, b in at], terms)
    start = best_window(found, len(at), sentences(text, at), n)
    stop = min(len(at), start + n)
    merged: list[list[int]] = []  # occurrences that overlap are marked as one
    for a, b, _ in found:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    left = at[start][0] if start else 0
    right = at[stop - 1][1] if stop < len(at) else len(text)
    out, done = [ellipsis] if start else [], left
    for a, b in merged:
        if start <= a < stop:
            end = at[min(b, stop) - 1][1]
            out += [text[done : at[a][0]], marks[0], text[at[a][0] : end], marks[1]]
            done = end
    return "".join([*out, text[done:right], ellipsis if stop < len(at) else ""])


def snippet_column(col: str | Column, terms: list[Term], field: str, n: int | None = None) -> Column:
    """A snippet of one field as a column. Terms of other fields do not count."""
    wanted = [(t.tokens(), t.prefix) for t in terms if t.column in (None, field)]
    size = n or LENGTHS[field]

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, wanted, size))

    return make(col)


def with_snippets(rows: DataFrame, terms: list[Term]) -> DataFrame:
    """rows with snip, tsnip, isnip and psnip, for text, title, item title and presenter."""
    names = {"text": "snip", "title": "tsnip", "item_title": "isnip", "presenter": "psnip"}
    ship(rows.sparkSession)
    return rows.withColumns({names[f]: snippet_column(f, terms, f) for f in FIELDS})
