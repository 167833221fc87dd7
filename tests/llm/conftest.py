import random

import pytest


def prose(rng, n, vocabulary=400):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) + (".\n" if rng.random() < 0.06 else "") for _ in range(n)).replace("\n ", "\n")


def edge_rows():
    """doc_id, text, source, lang, n_chars, and columns whose names operators use inside."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(24)]
    passage = prose(rng, 70).replace("\n", " ")
    texts = list(base)
    texts += [base[0], base[0], base[1]]  # exact copies
    near = base[2].split(" ")
    near[40] = "changed"
    texts.append(" ".join(near))
    for t in base[3:6]:  # a passage in the midst of others
        w = t.split(" ")
        texts.append(" ".join([*w[:20], passage, *w[20:45]]))
    texts += [None, "", "   \n\t ", "one two", "one", "One TWO", "été \U0001f642\U0001f642 naïve　text  two   three\r\nend ", "a<|endoftext|>b <|endoftext|>", "### ||| &&& word", "x" * 700 + " tail", "word " * 30000]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], (4, "another text under the same number", "s1", "en", 34), (None, "a text without a number", "s2", None, None), (None, None, None, None, None)]
    return [(*r, "extra", i, 1) for i, r in enumerate(rows)]


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size string, row int, text_hash int"


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
