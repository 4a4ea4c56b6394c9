"""Rows that every operator must take."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "The same words stand here, twice over.", "en", "a", 38),
    (5, "The same words stand here, twice over.", "en", "b", 38),
    (5, "The same words stand here, twice over.", "en", "b", 38),
    (None, "A text that has no id at all.", "en", "a", 29),
    (6, "word " * 60_000, "en", "c", 300_000),
    (7, "😀 é ▁ \u0000 ß ſ İ 中文 <b>&amp;</b>", "de", "c", 30),
    (8, "x" * 100_000, "de", None, 100_000),
]
