"""Items that a document holds more than once, and items that are mostly names or numbers."""

import pytest
from test_llm_operators import QUESTION

from tidegate.llm.decontamination import contaminated

OTHER = QUESTION.replace("Alice", "Carol").replace("12", "40").replace("kg", "lb").replace("Berlin", "Paris")
THIRD = QUESTION.replace("Alice", "Dora").replace("12", "55").replace("Bob", "Emil").replace("7", "9")
TITLE = "The Old Fisherman And The Quiet Sea Were Painted By Anna Berg In Oslo"
SUM = "Compute 12 + 30 - 8 * 4 / 2"


def found(spark, text):
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION), (2, TITLE), (3, SUM)], "item_id long, text string")
    return {r.item_id: (r.coverage, r.agreement, r.verbatim) for r in contaminated(docs, items).collect()}


@pytest.mark.parametrize(
    "text, verbatim",
    [
        (QUESTION + " " + OTHER, True),
        (OTHER + " Some words between them. " + QUESTION, True),
        (OTHER + " " + THIRD, False),
        (" and so on, ".join([THIRD, OTHER, THIRD, OTHER]), False),
    ],
)
def test_an_item_with_several_values(spark, text, verbatim):
    assert found(spark, text) == {1: (1.0, 1.0, verbatim)}


@pytest.mark.parametrize("item, text", [(2, TITLE), (3, SUM)])
def test_copies_of_names_and_numbers(spark, item, text):
    for copy in (text, f"It says: {text}, and more.", text.lower(), text.upper()):
        assert found(spark, copy) == {item: (1.0, 1.0, True)}
    assert found(spark, "The Young Sailor Or The Loud Wind. Compute 13 + 31 - 9 * 5 / 3") == {}
