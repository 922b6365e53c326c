"""Rows with nulls, empty and odd texts, ties, repeats and columns that clash with inner names."""

ODD = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard int, score double, slot string"


def odd_docs(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [
        (1, t), (1, t), (2, t), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "one two three"), (None, t), (None, None),
        (8, "x" * 50_000), (9, "word " * 20_000), (10, "日本語 テキスト Σίσυφος ΟΔΟΣ İstanbul été ẛ̣ <|endoftext|> it's we'll 12 ½ ⅷ 👩‍👩‍👧 \x1c\x85a"),
    ]
    return spark.createDataFrame([(*r, "en", None, 7, 5, 1, 0.5, "s") for r in rows], ODD)


def no_docs(spark):
    return spark.createDataFrame([], ODD)
