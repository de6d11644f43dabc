import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def corpus():
    """{id: text}: own texts, exact copies, near copies, texts with a shared passage, short, empty and null ones."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, out, i = text(70), {}, 0
    for _ in range(60):
        out[i], i = text(rng.randint(30, 300)), i + 1
    for base in range(0, 12):
        for _ in range(rng.randint(1, 4)):
            w = out[base].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out[i], i = " ".join(w), i + 1
    crowd = text(150).split()
    for _ in range(70):  # one large group of near copies
        w = list(crowd)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out[i], i = " ".join(w), i + 1
    for _ in range(10):
        out[i], i = f"{text(rng.randint(5, 60))}\n{passage} {text(rng.randint(5, 60))}", i + 1
    for odd in ("", None, "one", "two words", "Two  WORDS", "three short words", " \n\t ", text(4000), "Ünïcode ſtraße Kelvin " * 20):
        out[i], i = odd, i + 1
    return out


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, "en", "s", None if t is None else len(t), 1.0) for i, t in corpus.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
