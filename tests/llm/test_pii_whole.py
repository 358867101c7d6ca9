import pytest

from palimpsest.llm import pii


@pytest.mark.parametrize(("text", "want"), [
    ("I moved to 12 Oak Court, Leeds.", "12 Oak Court, Leeds"), ("It is 7 Mill Place, Ashvale", "7 Mill Place, Ashvale"), ("Hauptstraße 12, Altenfurt", "Hauptstraße 12, Altenfurt"),
    ("calle Mayor 5, Madrid", "calle Mayor 5, Madrid"), ("12 rue de la Paix, Lyon", "12 rue de la Paix, Lyon"), ("Flat 3, 9 Elm Square, Leeds", "Flat 3, 9 Elm Square, Leeds"), ("Write to 4 Rose Crescent,\nYork", "4 Rose Crescent,\nYork"),
])
def test_addresses_without_postcode(text, want):
    got = [text[n.start:n.end] for n in pii.Finder(pii.Knowledge()).nodes(text) if n.shape == "address"]
    assert got == [want]
