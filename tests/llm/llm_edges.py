"""Rows that every operator on documents must take."""

LINES = "The first line has quite a few words to count here.\nAnother line of words follows the first one here."
EDGES = [
    (1, LINES),
    (2, LINES),
    (2, LINES),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "a row without a name"),
    (6, "word " * 40_000),
    (7, "x" * 100_000),
    (8, "café \U0001f600 naïve 中文"),
]
# Columns that operators add, as input columns of other types.
EXTRA = "score predicted spans base token_ids n_words items kept deleted rank key seq node".split()
CLASHING = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
