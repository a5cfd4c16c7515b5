"""Messages of any length, and such as hold none of the usual words."""

import json

import pytest

pytest.importorskip("pagewright.llm.catalog")

from pagewright.llm import residue  # noqa: E402

REFERENCE = " ".join(f"Request {k}-norithvo." for k in range(70000, 70030))
PROSE = "The archive page keeps the date of the last visit. "


@pytest.mark.parametrize("text", ["503 - we will be back", "xxxxx", "jkl", "bar baz", "Your text goes here. " * 20, "your text goes here " * 20, "Error 502: bad gateway. " + REFERENCE, "Please enable JavaScript to continue. " * 9])
def test_messages(text):
    assert residue.Residue().record(json.dumps({"a": text}))


@pytest.mark.parametrize("text", ["450 - 500 grams", PROSE * 9, "Something went wrong. " + PROSE * 9, "Your text goes here. " + PROSE * 9, "503", REFERENCE])
def test_content(text):
    assert not residue.Residue().record(json.dumps({"a": text}))
