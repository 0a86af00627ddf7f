import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length long, part int, rank int, h long, n long, salt int, text_hash long, root long, size long"


def fold(i, k):
    return zlib.crc32(("" if i is None else str(i)).encode()) % k


def _rows():
    """Nulls, empty and very long texts, ties, repeated rows; the extra columns clash with names that operators use."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "the", "of", "Zürich", "naïve", "日本語", "x" * 30]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = make(80)
    texts = [None, "", " \t\n", "one", "The End.", base, base, base + " end", base.replace("alpha", "omega", 1), make(5), make(300), make(60) + "\n" + make(3) * 4,
             "same line of twenty chars!\nmine one\n  SAME line of twenty chars! ", "same line of twenty chars!\nother", "x\nSame line of twenty chars!\t", "\n\n", "a\r\nb\x0bc\x0cd", "word " * 30_000,
             "# * $ % & | < >", "no stop\x00nul 🎉🎉", " para nbsp"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "S1", None, "é"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, "no id", "en", "s1", 5))
    rows.append((None, None, None, None, None))
    rows.append(rows[5])
    rows.append(rows[12])
    return [r + (0.5, 7, 1, 1, 1, 1, 1, 1, 1, 1) for r in rows]


@pytest.fixture(scope="session")
def odd_rows():
    return _rows()


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
