import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, th string, key string, kept_id string, taken double, bucket int, score string"


def words(rng, n):
    return [rng.choice(["the", "of", "an", "Éa", "über"]) if rng.random() < 0.3 else "".join(rng.choice(["ba", "ti", "on", "re", "sh", "é", "lo"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def corpus(seed=3):
    """(doc_id, text, source): clean texts, exact and near copies, shared passages, and awkward rows."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randint(30, 160))) for _ in range(24)]
    passage = " ".join(words(rng, 90))
    rows = [(k, t + ".\n" + t[: k * 3], f"s{k % 4}") for k, t in enumerate(base)]
    rows += [(100 + k, base[1], "s1") for k in range(3)]  # exact copies
    for k in range(6):  # near copies: one word changed
        w = base[2].split()
        w[k * 3] = "changed"
        rows.append((200 + k, " ".join(w), "s2"))
    rows += [(300 + k, " ".join(words(rng, 20)) + "\n" + passage + "\n" + " ".join(words(rng, 20)), "s3") for k in range(4)]
    rows += [(400, None, "s0"), (401, "", None), (402, " \t\n", "s0"), (403, "one", "s1"), (404, "ab " * 400, "s1"), (405, "x" * 1000, "s2")]
    rows += [(500, base[3] + " twin", "s0")] * 2  # repeated rows
    rows += [(501, "first of an id " + base[4], "s0"), (501, "second of an id " + base[5], "s0"), (None, "no id " + base[6], "s1"), (None, "no id " + base[6], "s1")]
    rows.append((600, " ".join(words(rng, 9000)), "s9"))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 7, "h", "t", "k", "x", 1.5, 3, "y") for d, t, s in rows], COLUMNS)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])
