import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, kept boolean, salt int, body string, component_id long"


def rows(texts):
    """documents with extra columns whose names clash with the operators' own."""
    return [(i, t, "en" if (i or 0) % 2 else "fr", "s", len(t or ""), "k", 7, False, 3, "b", 1) for i, t in texts]


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, and every odd case."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdeilmnorstu", k=rnd.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    passage, base = prose(80), prose(120).split(" ")
    texts = [prose(rnd.randint(1, 160)) for _ in range(60)]
    texts += [prose(30) + "\n" + passage + "\t" + prose(20) for _ in range(5)]
    texts += [passage, prose(10) + " " + " ".join(passage.split(" ")[:55]), " ".join(passage.split(" ")[:49])]
    for _ in range(8):
        near = list(base)
        for at in rnd.sample(range(len(near)), 2):
            near[at] = rnd.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(base), "  ".join(base), " ".join(base).upper(), " ".join(base)]
    texts += [None, "", " \n\t ", "x", "Ünïcödé wörds ß é", "it's a <|endoftext|> test", "日本語 текст العربية 🙂", "1 2 3 !!! ...", "a " * 300, "w" * 5000, "same\nsame\nsame\n\nother", "a|b|c #*$%&<>", prose(4000)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(rows(corpus), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark, corpus):
    """Every row twice, ties everywhere."""
    some = corpus[:10] + corpus[-15:]
    return spark.createDataFrame(rows(some + some), SCHEMA)


@pytest.fixture(scope="session")
def nameless(spark):
    """Null identifiers: two rows with one text, one of them named; one row alone."""
    text = "one two three four five six seven " * 10
    return spark.createDataFrame(rows([(None, text), (4, text), (None, "alone here")]), SCHEMA)
