import random

import numpy as np
import pytest

WORDS = {
    "en": "the of and to in that is was for on with as by at from this have are not river stone garden winter letter quiet morning".split(),
    "fr": "le la les de des et une dans que qui pour avec sur été être où déjà forêt maison hiver école matin fenêtre".split(),
    "de": "der die das und nicht mit ist auf für über schön straße fenster haus winter schule morgen wald größe".split(),
}


def prose(r: random.Random, lang: str, n: int) -> str:
    out = [r.choice(WORDS[lang]) + (str(r.randrange(60)) if r.random() < 0.3 else "") for _ in range(n)]
    return " ".join(out).capitalize() + "."


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame) of documents: three languages, copies, null, empty and very long texts, repeated rows, odd columns."""
    r = random.Random(5)
    rows = []
    for i in range(150):
        lang = ["en", "fr", "de"][i % 3]
        rows.append((i, prose(r, lang, r.choice([3, 20, 60, 120])), lang, "src0" if i % 3 else f"src{i % 5}"))
    rows += [(200 + i, rows[i % 10][1], rows[i % 10][2], "src0") for i in range(40)]  # exact copies
    rows += [(300 + i, rows[4][1] + f" tail{i}", "fr", "src0") for i in range(12)]  # near copies
    rows += [(400, None, None, None), (401, "", "en", None), (402, " \t\n", None, "x"), (403, "12 ... !!", None, "x"), (404, "Spaced\t\tout   words", "en", "x"), (405, "Spaced out words", "en", "x")]
    rows += [(406, prose(r, "en", 40_000), "en", "src0"), (407, "word" * 30_000, "en", "src0"), (408, "a b c", "en", "q"), (408, "a b c", "en", "q"), (408, "a b c", "en", "q")]
    schema = "doc_id long, text string, lang string, source string, kept boolean, id string, rank int, length string, score string"
    full = [(*x, True, "clash", 1, "clash", "clash") for x in rows]
    return rows, spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus[1].limit(0)


@pytest.fixture
def rng():
    return np.random.default_rng(3)
