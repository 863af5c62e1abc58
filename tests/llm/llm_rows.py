"""Rows for the tests of this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Odd rows that every operator has to take: null, empty and blank texts, nulls elsewhere, repeated rows.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, None),
    (3, "  \n\t ", "en", "a", 5),
    (4, "one two three four five six seven eight nine ten", "en", "a", 48),
    (4, "one two three four five six seven eight nine ten", "en", "a", 48),
    (5, "ONE two three four five six seven eight nine ten", "en", "b", 48),
    (6, "un été à la plage où naît İstanbul 日本 <|endoftext|>", "fr", "b", 50),
    (None, "no id here at all my friend", "en", None, 27),
    (7, "x", "de", "c", 1),
    (8, "word " * 30000, "en", "a", 150000),
]
