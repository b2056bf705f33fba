import pytest

LONG = "lorem ipsum dolor " * 30_000 + "x" * 70_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use inside."""
    texts = [
        (1, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten"), (3, "One TWO three four five six seven eight nine ten"), (4, None), (5, ""), (6, " \n\t "), (7, "word"), (8, "WORD"), (None, "no id here at all my friend"), (None, None),
        (9, "repeated row with enough words in it"), (9, "repeated row with enough words in it"), (10, LONG), (11, "mail a.b@c.de or +1 (234) 555-1234, 1.2.3.4 and 4111 1111 1111 1111"), (12, "naïve café \U0001f600 漢字 <|endoftext|> it's\x1c  two\n\nlines \x85\xa0end "), (13, "same id, first text of two rows"), (13, "same id, other text of two rows"),
    ]
    extra = "start n node gram root key row base score length bucket k term offset chunk held_out count".split()
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[7] * len(extra)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in extra)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
