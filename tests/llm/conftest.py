import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, k int, chunk string, component_id string, `_id` int, label string"
SYLLABLES = "an the tion ing er on st ou ha wh ly ea bl re th ne".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def rows_of(texts):
    """(id, text) pairs as documents, with columns that operators use themselves."""
    return [(i, t, "en" if (i or 0) % 2 else "fr", None if i in (3, None) else f"s{i % 4}", len(t or ""), 1.0, "x", 7, "y", "z", 1, "l") for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Exact and near copies, shared passages, odd texts, repeated rows, null ids, a very long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(40)]
    passage = prose(rng, 30)
    texts = [(i, t) for i, t in enumerate(base)]
    n = len(texts)
    for k in range(30):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = "zzz" + str(k)
        texts.append((n + k, " ".join(words)))
    n = len(texts)
    texts += [(n + k, f"{prose(rng, 8)} {passage} {prose(rng, 8)}\n{base[k][:70]}") for k in range(8)]
    n = len(texts)
    odd = [None, "", " \t\n", "one", "One", "two words", "a b c", "A B c d", "ab" * 400, "é" * 90, "é" * 91 + "x", "\x00ctl\x00" * 20, "😀 " * 60, base[0] + "\n" + base[0], prose(rng, 6000)]
    texts += [(n + k, t) for k, t in enumerate(odd)]
    texts += [texts[1], texts[1], (2, base[5]), (None, base[7]), (None, None)]
    rng.shuffle(texts)
    return texts
