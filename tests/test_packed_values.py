import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstream.operators.packed_values import cuts, split_authors, split_pages, unpack_values


@pytest.mark.parametrize(
    ("value", "items"),
    [
        (None, []),
        ("", []),
        ("   ", []),
        (";,;", []),
        ("Smith, John", ["Smith, John"]),
        ("Smith, Jr., John; Doe, A.", ["Smith, Jr., John", "Doe, A."]),
        ("J. Smith, A. B. Doe", ["J. Smith", "A. B. Doe"]),
        ("J. Smith, A. Doe and C. Roe", ["J. Smith", "A. Doe", "C. Roe"]),
        ("J. Smith, A. Doe, and C. Roe", ["J. Smith", "A. Doe", "C. Roe"]),
        ("{Text, Print and Web; Roe} and A. Doe", ["Text, Print and Web; Roe", "A. Doe"]),
        ('"Roe & Doe, Ltd." / A. Doe', ["Roe & Doe, Ltd.", "A. Doe"]),
        ("{Institute for Layout and Typography}", ["Institute for Layout and Typography"]),
        ("زهرا نابیدا؛خدیجه موپیچی", ["زهرا نابیدا", "خدیجه موپیچی"]),
        ("زهرا نابیدا و خدیجه موپیچی", ["زهرا نابیدا", "خدیجه موپیچی"]),
        ("نابیدا، زهرا", ["نابیدا، زهرا"]),
        ("A. Roe\nB. Doe", ["A. Roe", "B. Doe"]),
        ("O'Neil, B. and D'Arcy, C.", ["O'Neil, B.", "D'Arcy, C."]),
        ('never "closed; A. Doe', ['never "closed', "A. Doe"]),
    ],
)
def test_authors(value, items):
    assert split_authors(value) == items


@pytest.mark.parametrize(
    ("value", "items"),
    [(None, []), ("12–29, 47", ["12–29", "47"]), ("۲۱۸–۲۳۵، ۲۶۰", ["۲۱۸–۲۳۵", "۲۶۰"]), ('1-2,"105, suppl."', ["1-2", "105, suppl."]), ("3 & 4 and 5 + 6", ["3", "4", "5", "6"]), ("e1--e9", ["e1--e9"])],
)
def test_pages(value, items):
    assert split_pages(value) == items


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_nothing_is_lost(value):
    """Items are substrings in order, and every cut is a delimiter."""
    at = 0
    for item in split_pages(value):
        at = value.find(item, at)
        assert at >= 0
        at += len(item)
    assert all(0 <= a < b <= len(value) for a, b, _ in cuts(value))


def test_long_and_nested():
    value = "{" * 500 + "a; b" + "}" * 500
    assert len(split_authors(value)) == 1
    assert len(split_pages(", ".join(map(str, range(20_000))))) == 20_000


def test_frame(spark):
    rows = [(1, "A. Roe; B. Doe", "1, 2", "x"), (1, "A. Roe; B. Doe", "1, 2", "x"), (2, None, "", "x"), (None, "A. Roe and B. Doe", None, "x"), (3, "Roe, A.", "7", "x")]
    df = spark.createDataFrame(rows, "bib_id bigint, author string, pages string, item string")
    found = {tuple(r) for r in unpack_values(df, "bib_id").collect()}
    assert found == {(1, "author", 1, "A. Roe"), (1, "author", 2, "B. Doe"), (1, "pages", 1, "1"), (1, "pages", 2, "2"), (None, "author", 1, "A. Roe"), (None, "author", 2, "B. Doe")}
    assert unpack_values(df.limit(0), "bib_id").count() == 0
