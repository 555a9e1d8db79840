import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with copies, shared passages, empty and null texts, ties, a long text, and columns with clashing names."""
    import random

    r = random.Random(11)
    words = ["w%d" % i for i in range(400)] + ["the", "of", "and", "été", "naïve"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(70)
    rows = []
    for k in range(40):
        body = text(r.choice([3, 20, 60, 150]))
        if k % 4 == 0:
            body = f"{body} {passage} {text(10)}"
        rows.append((k, body))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, rows[8][1].replace("w1", "w2", 1)), (53, None), (54, ""), (55, " \n\t "), (56, "x"), (57, "aaaa" * 120), (58, "aaaa" * 120), (59, text(6000))]
    full = [(k, t, ("en", "fr", None)[k % 3], ("s1", "s2", None)[k % 3], len(t or ""), "clash", 7) for k, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, size int").repartition(5)


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
