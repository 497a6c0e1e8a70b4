"""Rows without an id, or with one that others have, are rows of their own."""

from orbitway.llm import mixing, shingle_sets, simhash

ROWS = [
    (None, "one two three four five six seven", "s", 1),
    (None, "entirely other words stand in this row", "s", 2),
    (None, "a third text without any id at all", "s", 3),
    (None, "a third text without any id at all", "s", 4),
    (7, "the text of seven is this one here", "s", 5),
    (7, "another text has the same number seven too", "s", 6),
    (8, "One two three  four five six seven", "s", 7),
]


def texts(frame):
    return sorted(r["text"] for r in frame.collect())


def test_keep_first_keeps_a_row_of_each_component(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, extra long").repartition(3)
    # Row 8 has the only id of its component; the third text comes twice and stays once.
    want = sorted([ROWS[6][1], ROWS[1][1], ROWS[2][1], ROWS[4][1], ROWS[5][1]])
    assert texts(simhash.keep_first(docs, 5, 2)) == want
    assert texts(shingle_sets.keep_first(docs, 5)) == want


def test_smallest_text_of_a_repeated_id_stays(spark):
    docs = spark.createDataFrame([(1, "B a c d e f"), (1, "b a  c d e f"), (1, "B a c d e f"), (2, "A")], "doc_id long, text string")
    for kept in (simhash.keep_first(docs, 5, 2), shingle_sets.keep_first(docs, 5)):
        assert texts(kept) == ["A", "B a c d e f"]


def test_arrange_takes_each_row_once(spark):
    """A single source's target is its own words, so that each row comes once."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, extra long").repartition(3)
    assert sorted(r["extra"] for r in mixing.arrange(docs).collect()) == [1, 2, 3, 4, 5, 6, 7]
