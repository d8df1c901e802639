import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(r):
    return "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))


def sentence(r, n):
    return " ".join(word(r) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies in chains, short and odd texts; nulls in every column; ids are distinct."""
    r = random.Random(11)
    texts = []
    for _ in range(25):
        base = sentence(r, r.randint(30, 90)).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            base = list(base)
            for _ in range(r.randint(1, 4)):
                base[r.randrange(len(base))] = word(r)
            texts.append(" ".join(base))
    texts += ["", None, " \t\n", "One", "one", "two words", "three short words", "exactly four words here", "Exactly FOUR words here"]
    texts += ["line a b c d\nline a b c d\nother line", "ÀÉ naïve ÀÉ naïve", "x " * 400, "a*b#c$ d%e&f|g <h>", " odd space"]
    texts.append(sentence(r, 30_000))
    texts += ["same again and again here"] * 40
    rows = [(k, t, r.choice(["en", None]), r.choice(["src0", "src0", "src1", "src2", None]), len(t or "")) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables into a folder that the queries read."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
