import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts: null and repeated ids, columns whose names clash
    with those of the operators."""
    def make(texts, langs=None, partitions=3):
        rows = [(i if i % 9 else None, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}", len(t or ""), i, "x", 1.5)
                for i, t in enumerate(texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, length long, c string, score double"
        ).repartition(partitions)
    return make


EDGE_TEXTS = [None, "", " \n\t", "a", "One two", "one TWO", "z" * 700, "ab" * 300, "é ́x ñ", "x  y\r\n z", "<|endoftext|> b",
              "\x01 \x00 b", "日本語テキスト" * 40, "don't I'll 's 12 345", "w " * 3000]


@pytest.fixture(scope="session")
def edge_texts():
    return list(EDGE_TEXTS)
