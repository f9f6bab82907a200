import random

import pytest

CLASHES = "_key _row _text _n size words hits found rk did keep root c1 n token ids data block fp kind task lang_pred score ranges".split()
TABLE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows and ids."""
    rng = random.Random(7)
    base = [passage(rng, 60) for _ in range(6)]
    shared = passage(rng, 90)
    line = "This line of the footer stands in many documents."
    rows = []
    for i, text in enumerate(base):
        rows.append((i, text, "en", "a"))
        words = text.split()
        words[20 + i] = "changed"
        rows.append((100 + i, " ".join(words), "en", "b"))          # near copy
        rows.append((200 + i, text, "de", "a" if i % 2 else None))  # exact copy
    rows += [(300 + i, f"{passage(rng, 8)}\n{line}\n{shared}\n{passage(rng, 9)} {i}", "fr", "c") for i in range(9)]
    rows += [(400, None, None, None), (401, "", "en", "a"), (402, " \t\n\r ", None, "b"), (403, "one", "en", "c"), (404, "two words", "en", "c"),
             (None, base[0], "en", "a"), (None, None, None, None), (405, "Ünïcödé ñandú 中文 🙂  x", "es", "c"),
             (406, "12 345 -- !!", "en", "b"), (407, "a" * 30_000, "en", "a"), (408, passage(rng, 12_000), "en", "a")]
    rows += [(2 ** 62 + 1, "an id that no double holds", "en", "a"), (-5, "a negative id", "en", "a")]
    rows += [rows[0], rows[0], (1, "another text with the id of one", "en", "b")]
    return rows


def frame(spark, rows):
    full = [(d, t, la, s, None if t is None else len(t), *["x"] * len(CLASHES)) for d, t, la, s in rows]
    return spark.createDataFrame(full, TABLE).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def fixture_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()

