import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, size long, word string, body string, low string, wide string, flat string, x string, id long, part int, tokens long, c string, m string, rep long, fp string, sample int, ids string, range int, lead string, _q string, _kept string, _lang string, _source string, _symbols_high long, _m string, _t string, _a string, _i string, _row string, n_entities long, kinds string, inner string, _outer string, salt int, token long, g long, cid long, least long"
PROSE = "the river rose in the night and by morning it had taken the lower road and the small bridge by the mill so that nobody could cross to the other side before noon when the water fell again and the men came down with ropes and planks to see what was left of it all"


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, len(text) if text else None, 1, "k", 2, "w", "b", "l", "w", "f", "x", 9, 1, 5, "c", "m", 3, "p", 0, "i", 4, "e", "own", "own", "own", "own", 1, "own", "own", "own", "own", "own", 7, "own", "own", "own", 1, 2, 3, 4, 5)


ROWS = [
    row(1, None), row(2, ""), row(3, " \n\t\r\x0b\x0c \n"), row(4, "a"), row(5, "one two three"),
    row(6, "word " * 6000), row(7, "x" * 150_000, None, None), row(8, PROSE), row(8, PROSE), row(9, PROSE, None, "s2"), row(10, PROSE.upper(), "de", None),
    row(8, "quite another text under the same id"), row(None, PROSE), row(None, None), row(11, "é 你好 ▁ \u0000 \U0001f600 ﬁ İstanbul\n" * 3), row(12, "line one here\n" * 40), row(13, "1 2 3 4 5 6 7 8 9"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, odd characters and columns with names that operators use."""
    return spark.createDataFrame(ROWS, DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, PROSE[:150]), (2, None), (3, ""), (4, "short"), (5, PROSE[:150]), (None, PROSE[:150])], "item_id long, text string")


@pytest.fixture(scope="session")
def corpus():
    return "/root/testdata/sf0.001"
