import pytest

EDGE = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", None),
    (3, None, None, "s1"),
    (4, "", "en", "s2"),
    (5, " \t\n\x0b ", None, "s2"),
    (6, "one", "de", "s1"),
    (6, "one", "de", "s1"),
    (7, "One", None, "s3"),
    (8, "two words", "fr", None),
    (9, "été à la plage \U0001f600 password: hunter2hunter2 fin", "fr", "s2"),
    (10, "word " * 30_000 + "end", "en", "s4"),
    (None, "no id here but some words to read", "en", "s1"),
]


CLASHES = "n id rank spans blob size target taken kept first node text_hash label grp _n _size _key _mark _blob _spans _rank _salt _start _of _at _again length piece sequence_id offset score words name start".split()


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and further columns whose names clash with the operators' own."""
    rows = [(*r, *range(len(CLASHES))) for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in CLASHES))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
