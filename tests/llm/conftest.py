import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, fp long, y int, u long, tie long, leaf int, file string, bucket int"


def rows(texts):
    """Rows with null in every other column and names that operators use inside."""
    return [(i, t, None, None, None if t is None else len(t), 0.5, 1, 2, None, 3, 4, 5, "f", None) for i, t in texts]


@pytest.fixture(scope="session")
def odd_texts():
    """(id, text): copies, near copies, shared passages, empty, null and long texts."""
    rng = random.Random(5)
    voc = ["".join(rng.choice("abcdeghilmnorstuvwé") for _ in range(rng.randint(2, 9))) for _ in range(160)]
    line = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    base = ["\n".join(line(rng.randint(4, 14)) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    shared = "\n".join(line(20) for _ in range(4))
    texts = [*base, base[0], base[0], base[1] + " end", base[2].upper(), f"{base[3]}\n{shared}\n{line(5)}", f"{shared}\n{base[4]}",
             "", None, "\n\n\n", "one", "one two", " \t\n ", "a\x1cb  c\x85d\n\nA&B <|endoftext|> it's 3,14!",
             "\n".join([line(9)] * 8), line(4000), "x" * 5000, "", None]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame(rows(odd_texts), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def twice(spark, odd_texts):
    """The same with a null id and a row that occurs twice."""
    return spark.createDataFrame(rows([*odd_texts, odd_texts[3], odd_texts[3], (None, "null id text here"), (None, None)]), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet").cache()
