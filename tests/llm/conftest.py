import pytest

from quillspark.session import Scratch, ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, node string, h string, fp string"
BASE = "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the dark forest of the north "


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, ties and columns with clashing names."""
    texts = [
        (1, BASE * 4), (2, BASE * 4), (3, BASE * 4 + "x"), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two"), (9, "Ünïcode Größe 😀 straße déjà vu " * 9),
        (10, BASE * 900), (11, "be " * 3000), (12, BASE + "y" * 300), (13, "12345 !!! ###"), (14, BASE * 2 + "password = hunter2hunter2 " + BASE), (None, "no key here " * 20), (15, "one"),
        (15, "one"), (16, "AKIA" + "Z" * 20 + " token: \"abcdef0123456789abcdef0123456789\" "),
    ]
    langs, sources = ["en", "fr", None], ["src1", "src2", None]
    return [(k, t, langs[i % 3], sources[i // 3 % 3], len(t or ""), "p", "k", "n", "h", "f") for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edges(spark):
    ship_package(spark)
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    ship_package(spark)
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def scratch(spark):
    s = Scratch(spark, "test")
    yield s
    s.close()
