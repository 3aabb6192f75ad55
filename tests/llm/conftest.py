import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empty and short texts, long ones, copies, near copies, shared passages and repeats."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, base = text(40), text(120)
    docs = [None, "", "   \n\t ", "one", "One", "a b c", text(30)]
    docs += [base] * 3 + [base.upper().replace("W", "w")]
    for _ in range(30):
        near = base.split()
        for _ in range(rng.randint(1, 6)):
            near[rng.randrange(len(near))] = rng.choice(words)
        docs.append(" ".join(near))
    docs += [f"{text(rng.randint(0, 60))} {passage} {text(rng.randint(0, 60))}" for _ in range(15)]
    docs += ["again " * 90, text(25) + "\n" + passage + "\n" + passage, "é ünïcode ▁ 漢字 🙂 " * 12, text(4000)]
    docs += [text(rng.randint(1, 80)) for _ in range(20)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, 2, "x") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int, part int, copies string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
