import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, body string, row_no int"


def prose(i: int, n: int) -> str:
    stems = ["the", "of", "and", "river", "stone", "winter", "a", "to", "in", "garden", "letter", "is", "was", "cloud"]
    return " ".join(stems[(i * 7 + k * k * 3 + k * i) % len(stems)] + ("" if k % 5 else str((i + k) % 97)) for k in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    rows = []
    for i in range(60):
        rows.append((i, prose(i % 40, 20 + 9 * (i % 13)), "en", f"s{i % 3}", None, 1, None, "x", 5))
    long = prose(3, 30_000)
    rows += [
        (100, long, "en", None, 0, None, "t", None, None),
        (101, long + " end", None, None, 0, None, "t", None, None),
        (102, None, None, None, None, None, None, None, None),
        (103, "", "en", "s0", None, None, None, None, None),
        (104, " \n\t ", "fr", "s1", None, None, None, None, None),
        (None, "one two", "en", "s2", None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
        (105, "same row twice here", "de", "s2", None, None, None, None, None),
        (105, "same row twice here", "de", "s2", None, None, None, None, None),
        (106, "ÉTÉ Straße <|endoftext|> don't 12 ...", "fr", "é", None, None, None, None, None),
        (107, "a b c a b c a b c\nline\nline\n\nline", "en", "s0", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()
