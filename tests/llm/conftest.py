import random

import pytest

#: Extra columns with names that the operators use themselves.
EXTRA = "g_k long, g_text string, g_spans int, kept string, size string, shard int, score string, carried int, root int, words string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, blanks, a very long text, repeated rows."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))

    shared, long = prose(60), prose(6000)
    texts = [prose(rng.randint(1, 200)) for _ in range(40)]
    texts += [texts[3]] * 5 + [texts[4].replace(" ", "\t ", 3)] + [t + " " + shared for t in texts[5:12]] + [shared + prose(20), long, long + " end", "ab " * 400, "ab " * 90]
    texts += [texts[7].replace("a", "b", 1), None, "", "  \n\t ", "x", "Same  WORDS here", "same words HERE", None]
    rows = [(i + 10, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, texts[2], "en", "a", 1), (None, None, None, None, None), (3, texts[8] + " tail", "en", "c", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    names = [x.split()[0] for x in EXTRA.split(",")]
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'7' AS {n}" for n in names]).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
