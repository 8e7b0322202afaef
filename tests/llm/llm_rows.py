"""Rows that the tests share."""

import random
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_ string, key string, size string, row string, label string, n string"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    lines, left = [], n
    while left > 0:
        k = min(left, rng.randint(3, 14))
        lines.append(" ".join(f"w{rng.randint(1, vocabulary)}{'abcdef'[rng.randint(0, 5)]}" for _ in range(k)))
        left -= k
    return "\n".join(lines)


def near(text, seed, changes):
    rng = random.Random(seed)
    parts = text.split(" ")
    for _ in range(changes):
        parts[rng.randrange(len(parts))] = f"x{rng.randint(0, 10**6)}"
    return " ".join(parts)


def corpus():
    """Odd texts, copies and near copies; every row also has columns whose names the operators use."""
    texts = [prose(i, 20 + 13 * i) for i in range(24)]
    texts += [texts[5], texts[5], near(texts[9], 1, 2), near(texts[9], 2, 3), near(texts[20], 3, 5), texts[3].upper()]
    texts += [None, "", " \t\n ", "one", "a b c d", "A b C d", "a b c d e", "\n\n\n", "é中\U0001f600 İstanbul ΣΣ x", "same " * 300]
    texts += [prose(77, 9000), "z" * 30000, "line one here\nline two here\nline three here\n" * 4]
    rows = []
    for i, text in enumerate(texts):
        lang = ("en", "de", None)[i % 3]
        source = ("b", "a", None, "c", "é")[i % 5]
        rows.append((i, text, lang, source, None if text is None else len(text), "x", "k", "9", "r", "l", "n"))
    rows.append(rows[7])
    rows.append((None, "a text that has no number at all", "en", "a", 32, "x", "k", "9", "r", "l", "n"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
