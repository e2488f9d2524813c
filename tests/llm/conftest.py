import pytest

from gaugewell.llm.shipping import ship


@pytest.fixture(scope="session")
def llm(spark):
    return ship(spark)


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(llm):
    """A table of documents from (id, text) or (id, text, source) rows."""
    def make(rows):
        rows = [(*r, "src0")[:3] for r in rows]
        return llm.createDataFrame(
            [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENT).repartition(3)
    return make


LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_cases(documents):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "one"), (6, "one"), (None, "no id at all"),
            (None, None), (7, "é日本 ünï 😀 text"), (8, "one two three", None), (9, "x" * 100_000)]
    frame = documents(rows)
    for name in ("id", "label", "score", "fingerprint", "component_id", "mix_block", "digest", "bucket", "fp", "__x", "kind"):
        frame = frame.selectExpr("*", f"cast(null as string) as `{name}`")
    return frame


@pytest.fixture(scope="session")
def no_documents(llm):
    return llm.createDataFrame([], DOCUMENT)
