import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tradearea.sources.shipping import ship
    ship(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, copies, shared passages, a clashing column."""
    a = " ".join(f"w{i % 37}x{i}" for i in range(80))
    b = " ".join(f"v{i % 11}y{i}" for i in range(60))
    near = a.replace("w5x5", "changed").replace("w6x80", "other")
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, a, "src0"), (2, a, "src0"), (3, near, "src1"), (4, b + "\n" + a, "src1"), (5, "head\n" + b + "\ntail", None),
        (6, None, "src0"), (7, "", "src2"), (8, " \n\t ", None), (9, "three small words", "src2"), (10, "Three SMALL words", "src2"),
        (11, f"before {passage}, after; {passage[4:]} thirteen", "src1"), (12, "junk " * 200, "src0"), (13, "A#& B%% " * 40, "src0"),
        (None, a, "src0"), (None, None, None), (2, a, "src0"), (14, "é ñ x ü " * 30 + "\n" + b, "src3"), (15, "Lorem ipsum. " * 9000, "src0"),
        (16, "line of six words is here\n" * 12, "src3"), (17, a.upper(), "src0"), (18, passage, "src0"), (19, "ten", "src0"),
    ]
    return spark.createDataFrame([(*r, "clash", r[0] or 0) for r in rows], "doc_id long, text string, source string, kept string, n_words long").withColumn(
        "lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("en"))
