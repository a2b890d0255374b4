"""Rows that the tests share."""

#: Rows that every operator on documents must take: nulls in any column, empty and very long texts, ties, repeated rows.
LONG = " ".join(f"word{i % 997} of{i % 13}" for i in range(40_000))
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 59, 7),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "b", 59, 7),
    (3, None, "en", "a", None, 7),
    (4, "", None, None, 0, 7),
    (5, LONG, "en", "a", len(LONG), 7),
    (6, " \t\r\n\x0b ", "en", "b", 6, 7),
    (7, "日本語 é😀 \x00 ▁x <s>", "de", None, 17, 7),
    (7, "日本語 é😀 \x00 ▁x <s>", "de", None, 17, 7),
    (None, "no id here", "fr", "c", 10, 7),
    (8, LONG, "en", "c", len(LONG), None),
    (9, "a", "en", "a", 1, 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra} int"
CLASHING = ["fp", "h", "key", "size", "shard", "score", "doc", "keep_id", "slot", "x"]
