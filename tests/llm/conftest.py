import pytest


@pytest.fixture
def docs(spark):
    def make(rows, more=()):
        """rows: (doc_id, text); more: extra columns, all with the same value in every row."""
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for name, value in more:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make


#: Null id, null, empty and blank texts, a repeated row, and a long text of one word.
ODD = [(None, "a null id"), (1, None), (2, ""), (3, " \t\n"), (4, "twice the same row"), (4, "twice the same row"), (5, "x" * 200_000), (6, "é ü ß 漢字 😀 ▁ \x1c"), (7, None)]
#: Columns with the names that the operators use inside.
CLASH = [("id", 1), ("part", 2), ("fp", 3), ("row", 4), ("text2", "x"), ("th", 5), ("kept", True), ("n_lines", 9), ("key", "k"), ("range", 3), ("next", "n")]
CLASH += [(name, "c") for name in ("cid", "hub", "sig", "digest", "node", "root", "line", "rank", "words", "spans", "wanted", "place", "before", "length", "open", "tie", "tags")]


def odd_cases(docs, operator, rows_out=None):
    """Runs an operator over odd rows, with clashing columns, and over an empty table; returns the rows for the odd ones."""
    plain = operator(docs(ODD)).collect()
    clashing = operator(docs(ODD, CLASH)).collect()
    names = plain[0].asDict().keys()
    key = lambda r: str([r[n] for n in names])
    assert sorted(map(key, plain)) == sorted(map(key, clashing))
    if rows_out is not None:
        assert len(plain) == rows_out
    assert operator(docs([])).collect() == []
    return plain
