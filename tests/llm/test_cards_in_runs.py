"""Card numbers beside other numbers."""

import re

import pytest

from codeloom.llm import pseudonyms

CARD, SPACED = "4785380592391139", "4111 1111 1111 1111"
CASES = [
    (f"{SPACED} 05/27", 1), (f"{CARD} 12 items", 1), (f"No. 5 {CARD}", 1), (f"{CARD}-12", 1), (f"3 {SPACED} 99", 1),
    (f"{CARD} {SPACED}", 2), (f"1 {SPACED} 4 {CARD} 2 {CARD}", 3), (f"{SPACED} 5x", 1), (f"{SPACED} 2027-05-01", 1),
    (f"{CARD} 10.20.30.40", 1), (f"{CARD} 05/27/2027", 1), (f"{CARD} 12-x@example.com", 1), (f"1 2 3 {CARD} 4 5 6 7", 1),
    ("12-34-5678-9012-345@example.com", 0), ("4785380592391138 1", 0),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r for r in pseudonyms.pseudonymise(rows, "key").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_card_beside_numbers(found, i):
    text, cards = CASES[i]
    out = found[i]
    assert out.pii_card == cards
    assert CARD not in out.text and SPACED not in out.text
    assert re.sub(r"\d", "0", out.text[:16]) == re.sub(r"\d", "0", text[:16])
    for kind, part in (("pii_date", "2027-05-01"), ("pii_address", "10.20.30.40"), ("pii_date", "05/27/2027"), ("pii_mail", "@")):
        if part in text:
            assert out[kind] == 1 and (part == "@" or part not in out.text)


def test_numbers_beside_a_card_stay_and_equal_cards_stay_equal(found):
    one, two, three = found[1].text, found[2].text, found[6].text
    card = one.split()[0]
    assert one == f"{card} 12 items" and two == f"No. 5 {card}"
    assert three.startswith("1 ") and three.endswith(f" 4 {card} 2 {card}")
    assert found[0].text.endswith(" 05/27") and found[14].text == "4785380592391138 1"
