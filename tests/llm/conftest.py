import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases and copies: null, empty, white space, one word, long, equal up to white space, near copies, shared passages."""
    long = prose(1, 3000)
    base = prose(2, 300)
    passage = prose(3, 120)
    near = base.split()
    near[150] = "changed"
    return [
        (1, None, "en", "b", 0), (2, "", None, None, 0), (3, " \t\n ", "en", "a", 4), (4, "word", "fr", "a", 4),
        (5, long, "en", "c", 1), (6, long, "en", "c", 1), (7, base, "en", "a", 2), (8, base.replace(" ", "  \n"), "en", "b", 2),
        (9, " ".join(near), "en", None, 2), (10, prose(4, 50) + " " + passage + " " + prose(5, 60), "fr", "a", 1),
        (11, prose(6, 80) + "\n" + passage + " " + prose(7, 10), "fr", "d", 1), (12, "a" * 5000, "de", "a", 1),
        (13, "naïve façade 漢字 😀 straße " * 30, "de", "b", 1), (13, "naïve façade 漢字 😀 straße " * 30, "de", "b", 1),
        (None, base, "en", "a", 2), (None, None, None, None, None), (15, "the two words", "en", "a", 3), (16, "THE TWO WORDS", "en", "a", 3),
        (17, "0" * 20000 + " <|endoftext|> x", "en", "a", 1), (18, prose(2, 300) + " tail", "en", "b", 1),
    ]


DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def clash(docs):
    """Further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["size", "target", "key", "cls", "run", "spans", "base", "score", "lang_pred", "t", "sig", "copies", "lam", "held_out", "pid", "n"]
    return docs.withColumns({n: F.lit("x") for n in names})
