import numpy as np
import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Write rows as a table on disk, as the operators get them, and read it."""
    folder = tmp_path_factory.mktemp("tables")
    made = []

    def store(rows, schema=DOCUMENT, parts=3):
        path = f"{folder}/t{len(made)}.parquet"
        made.append(path)
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return store


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences of invented words."""
    random = np.random.default_rng(1)
    words = ["".join(random.choice(list("abcdefghilmnoprstu"), random.integers(2, 9))) for _ in range(900)]

    def text(n):
        return " ".join(random.choice(words, n))

    return text


def document(i, text, lang="en"):
    return (i, text, lang, "src", None if text is None else len(text))


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and very long texts, repeated rows."""
    long = prose(30_000)
    rows = [document(1, None), document(2, ""), document(3, "   \n\t "), document(4, long), document(4, long)]
    rows += [document(None, "null id " + prose(20)), document(5, "x" * 300_000), document(6, "é ü ñ 漢字 \U0001f600   ende")]
    return rows + [(7, "a b", None, None, None), (7, "a b", None, None, None)]
