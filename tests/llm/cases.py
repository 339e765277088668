"""Awkward documents that every operator meets: nulls, empty and long texts, repeats, clashing columns, no rows."""

LONG = "the long one goes on and on with thing after thing. " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, label string, n_lines int, component_id string, `row` int"


def awkward(spark):
    texts = [(1, "a plain text of a few words, and no more."), (2, None), (3, ""), (4, " \t\n\x0b "), (5, LONG), (6, LONG + "x"), (1, "a plain text of a few words, and no more."), (None, "no id here but words"), (None, None), (7, "É🎉 ümläut\r\nline\n\n"), (8, "...!!! 123 ### $$$"), (9, None)]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, 0.5, 1, "x", 1, "c", 2) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
