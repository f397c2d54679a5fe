import random

import pytest

#: Columns whose names the operators use inside or return; they must pass through or give way.
EXTRA = ("row_key", "kept_key", "hit_key", "mix_key", "node", "block", "size", "toxic_lang", "token", "w", "signature", "kept")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def make_rows(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls in every column, empty and long texts, and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "日本", "x,y", "A-b"]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = " ".join(words(40))
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append(" ".join(words(rng.randint(30, 90))))
        elif kind == 1:
            texts.append(rng.choice(texts).replace(" ", "  ", 3))
        elif kind == 2:
            near = rng.choice(texts).split()
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        elif kind == 3:
            texts.append(" ".join(words(20)) + " " + passage + "\n" + " ".join(words(20)))
        elif kind == 4:
            texts.append(rng.choice(texts))
        else:
            texts.append(" ".join(words(rng.randint(1, 4))))
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t)) for i, t in enumerate(texts)]
    long_text = " ".join(words(30_000))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, " \t\n", "en", "b", 3), (1003, long_text, "en", "a", len(long_text)), (1004, long_text + " more", "en", "a", 0)]
    rows += [(None, texts[0], "en", "a", 1), (None, "only here " + passage, None, "b", 1), rows[6], rows[6], (1005, "\x1c\x85  one\x0btwo \x00 three", "fr", "c", 5)]
    return [r + tuple("x" for _ in EXTRA) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
