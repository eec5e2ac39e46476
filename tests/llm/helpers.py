"""Small documents that hold every awkward case, and names that operators use inside."""

CLASHING = ["_row", "_key", "h", "w", "n", "fp", "key", "gram", "label", "z", "size", "copies", "shard", "depth", "cell", "id", "score", "runs"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def documents(spark, rows, clash=True):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        r = tuple(r) + (None,) * (4 - len(r))
        full.append((*r, len(r[1] or ""), *(["x"] * len(CLASHING) if clash else [])))
    return spark.createDataFrame(full, SCHEMA if clash else SCHEMA.partition(", `")[0])


def awkward(long_words=30_000):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(long_words))
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a"),
        (3, "", "en", "b"), (4, None, "en", "b"), (None, "text without an id", None, None), (None, None, None, None),
        (5, " \t\n ", "de", None), (6, long_text, "en", "c"), (7, "x", None, "a"), (7, "another text, same id", None, "a"),
        (8, "é ü ß 漢字 \U0001f600 � \x01", "fr", "c"),
    ]
