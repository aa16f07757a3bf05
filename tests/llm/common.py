"""Rows that every operator has to take: nulls, empty and long texts, repeated rows, other columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, anchor string, start int, words string, fingerprint string, node int, size int, whole int, target string, id string, copies int"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", 1, "w", "f", 3, 4, 5, "t", "i", 2) for r in full], SCHEMA)


ODD = [(None, "null id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (6, "Ünïcode — ＡＢ 😀 'll don't\r\n"), (7, "x" * 70_000), (8, "long words " * 9_000)]
