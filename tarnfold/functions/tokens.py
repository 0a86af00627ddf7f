"""The tokenizer: lower case, accents folded, runs of letters, numbers and private-use characters.

Accents fold where Unicode takes a letter apart into a base letter and marks (`ø`, `ł`, `ß` and `æ` are
letters of their own and stay); marks that follow a letter are dropped. The table follows from the
character database, so it is built from that rule.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = r"[\p{L}\p{N}\p{Co}]+"
#: As RUN, but with marks: a run in a text whose accents are not folded.
RAW_RUN = r"[\p{L}\p{N}\p{Co}" + "\u0300-\u036f]+"


@cache
def folding() -> tuple[str, str]:
    """(accented letters, then marks; base letters) for translate, which drops what has no counterpart."""
    accented, plain = [], []
    for point in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        c = chr(point)
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and all(unicodedata.combining(m) for m in marks):
            accented.append(c)
            plain.append(base)
    return "".join(accented) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), *folding())


def tokens(c: Column) -> Column:
    """The tokens of a text in order; null gives none."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(f"({RUN})"), 1)


def fold_text(text: str) -> str:
    """fold for a string on the driver."""
    return text.lower().translate(_table())


@cache
def _table() -> dict[int, str | None]:
    accented, plain = folding()
    return {ord(c): plain[i] if i < len(plain) else None for i, c in enumerate(accented)}


def tokens_of(text: str) -> list[str]:
    """tokens for a string on the driver: a search term."""
    import regex

    return regex.findall(RUN, fold_text(text))
