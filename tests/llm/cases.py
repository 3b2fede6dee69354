"""Small tables that hold the odd cases: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, n_words long, kept boolean, fp string, mix_slot string, spans string, j long, slot string, before string, `_h` long, row_no long, `_id` string"


def docs(spark, texts, source=None):
    rows = [(k, t, None, source(k) if source else f"s{(k or 0) % 3}", None, None, "clash", None, None, "clash", "clash", None, 5, "x", None, 1, 2, "i") for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
