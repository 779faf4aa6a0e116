import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and der die und que les ent ing thor neb vel onra tiso mar lok pir sut wen fal gro hib zun".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Plain, copied, nearly copied, repeated, empty, null and very long documents over few sources."""
    rng = random.Random(5)
    rows = []
    for i in range(160):
        rows.append((i, prose(rng, rng.randint(60, 200)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), 0))
    for i in range(160, 200):
        rows.append((i, rows[i % 7][1], "en", "hot", 0))
    for i in range(200, 240):
        words = rows[i % 3][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "a", 0))
    rows += [(240, "", "en", "a", 0), (241, None, None, None, None), (242, None, "en", "b", 0), (243, "one", "en", "b", 0), (244, " \n\t ", "en", "b", 0)]
    rows += [(245, prose(rng, 30_000), "en", "c", 0), (246, "x " * 400, "en", "a", 0), (247, "Caps!! " * 80, "en", "a", 0)]
    rows += [rows[5], rows[5], (None, prose(rng, 80), "en", "a", 0), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns named as operators might name theirs."""
    out = docs
    for name in ("size", "score", "shard", "kept", "target", "value", "key", "word", "fingerprint", "n", "index"):
        out = out.withColumn(name, out["doc_id"])
    return out
