"""Small tables with the cases every operator must handle."""

DOCS = "doc_id long, text string, source string, lang string, n_chars long, node long, block long, label string, kind int"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, s, "en", 0, 7, 7, "x", 7) for d, t, s in rows], DOCS)


def words(n, start=0):
    return " ".join(f"word{i}" for i in range(start, start + n))


EDGE = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, "one two", "b"),
    (5, "one two", "b"),
    (5, "one two", "b"),
    (None, words(40), "b"),
    (7, words(40), None),
    (8, words(38) + " x y", "c"),
    (9, words(30_000, 1000), "c"),
    (10, "ÀÉ 漢字 emoji 😀 " * 30, "c"),
]
