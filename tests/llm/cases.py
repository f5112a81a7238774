"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

TEXTS = [
    "one two three four five six seven eight nine ten",
    "one two three four five six seven eight nine ten",
    "One two three four five six seven eight nine ten",
    None,
    "",
    " \n\t ",
    "word",
    "a b c d",
    "été ÉTÉ naïve Σίσυφος ΟΔΟΣ İstanbul x́ ½ 한국어 😀 <|endoftext|> it's",
    "same line\nother line\nsame line\n\nsame line ",
    "again again again again again again again again again again again again",
    "x" * 5000,
    "lorem ipsum " * 4000,
    "SHOUT!! LOUD!! SHOUT!! LOUD!! a| b| c| d| e| f| g# h# i# j# k# l# m# n#",
]
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_ref int, kept string, mix_key int, fp int, digest string"


def documents(spark):
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), i, "k", 1, 2, "d") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, TEXTS[0], None, "src0", 1, 7, None, 1, 2, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)


def labels(spark):
    rows = [(0, 1, 0), (2, 1, 0), (7, 1, 1), (9, 1, 0), (10, 0, 0), (13, 0, 0), (13, 0, None), (None, 1, 1), (12, None, None), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
