import pytest

LONG = "lorem ipsum dolor sit amet " * 12_000 + "Z" * 3_000
EDGE = [
    (1, None), (2, ""), (3, "   "), (4, "word"), (5, LONG), (6, "the same text in two rows and more"), (7, "the same text in two rows and more"), (6, "the same text in two rows and more"),
    (8, "日本語 テキスト ひらがな"), (9, "a\0b  c"), (10, "<|endoftext|> hi <s> <|startoftext|>x"), (11, "one two three four five six seven"), (12, "Ünïcode é é ßtraße ﬁ 　 x"),
    (13, "trailing blank "), (14, " leading"), (15, "tab\tand\nline\r\nends"), (16, "\x1c\x85 odd \xa0 blanks"), (17, "!!! ??? ..."), (18, "12 345"), (None, "a text without an id"), (None, None), (19, "▁a▁ ▁ b"),
]


@pytest.fixture
def edge(spark):
    """Documents with every kind of odd row, and further columns whose names the operators use themselves."""
    extra = ["label", "score", "kept", "node", "cell", "part", "x", "y", "component", "sequence_id", "uid", "group", "rank"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    rows = [(d, t, None if (d or 0) % 3 == 0 else "en", None, None, *["?"] * len(extra)) for d, t in EDGE]
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(k, k % 2, None if k == 4 else (k + 1) % 2) for k in range(1, 20)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF
