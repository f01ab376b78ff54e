import pytest

EXTRA = "row string, body string, key string, code string, part int, length int, score double, n_lines int, shard int, words int, _order int, _bucket int, _key int, _value int, host string, at int, draws int, first int"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
COPY = " ".join(f"copied{i}" for i in range(60))

#: Nulls in every column, empty and blank texts, a very long one, ties and rows alike.
EDGES = [
    (1, COPY, "en", "a", 3), (2, COPY, "en", "a", 3), (2, COPY, "en", "a", 3), (3, None, "en", "a", None), (4, "", None, None, 0),
    (5, "   \n\t ", "en", "b", 5), (6, LONG, "en", "b", 1), (7, "one", None, "a", 3), (None, COPY + " tail", "en", None, 3),
    (None, None, None, None, None), (8, "Ünïcode 日本 words here \U0001f600", "de", "é", 9), (9, COPY + "\nline", "en", "a", 1),
    (2, "another text under the same number", "en", "a", 3),
]


@pytest.fixture
def edges(spark):
    """The awkward documents, with extra columns named like those the operators use."""
    names = [c.split()[0] for c in EXTRA.split(", ")]
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in EDGES], f"{DOCUMENT}, {EXTRA}")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture
def documents(spark):
    """A frame of ``documents`` from (doc_id, text) or (doc_id, text, source)."""
    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCUMENT)
    return make
