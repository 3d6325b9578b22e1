import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, n_words string, row string, copies string, runs string, shard string, n string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, and columns named like the operators' own."""
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 60)
    near = base.split()
    near[150] = "other"
    lines = "\n".join(prose(rng, 6) for _ in range(9))
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, base.upper(), "en", None),
        (5, passage + " " + prose(rng, 80), None, "b"), (6, prose(rng, 90) + "  " + passage, "fr", "b"), (7, None, "fr", "c"), (8, "", None, None),
        (9, " \t\n ", "fr", "c"), (9, " \t\n ", "fr", "c"), (None, "no number at all", "fr", "c"), (None, base, None, None), (11, "tie", "en", "a"), (11, "tie", "en", "a"),
        (12, "x" * 700, "en", "z"), (13, "#$% 123 \u0000 \U0001f600", None, "z"), (14, prose(rng, 30_000, 5000), "en", "z"), (15, lines, "fr", "a"), (16, "head\n" + lines + "\n\ntail", "fr", "a"),
        (17, "é" * 150 + " " + "é" * 150, "fr", "a"), (18, "a b c d e f g h i j k l " * 12, "en", "b"), (-3, "don't stop <|endoftext|> now  \n\n 12", "en", "b"), (19, "Übergröße ǅ ౝ ﬀ 　 end", "fr", "a"),
    ]
    return [(d, t, lang, s, None if t is None else len(t), "k", None, "9", "r", "2", None, "0", None) for d, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def edge_pairs():
    return [(r[0], r[1]) for r in edge_rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
