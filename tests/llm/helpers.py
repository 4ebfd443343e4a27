"""Small tables with every awkward case, shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, fp string, part int, ids string"


def documents(spark, texts, lang="en"):
    """Rows of (id, text) with further columns whose names the operators use inside."""
    rows = [(i, t, lang if isinstance(lang, str) else lang.get(i), None, None, None, 7, "x", 3, None) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for n in range(words):
        out.append(rng.choice(stock) + rng.choice(["", "", "", ",", "."]) + ("\n" if n % 17 == 16 else ""))
    return " ".join(out)


AWKWARD = [(1, None), (2, ""), (3, "   \t\n"), (4, "é😀 ﬁ ▁▁x"), (5, "word"), (6, "x" * 30_000), (7, "a b " * 5_000), (8, "line\nline\nline\n")]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
