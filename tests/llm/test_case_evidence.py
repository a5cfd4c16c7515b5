"""Letter case and signs as evidence for and against single-byte chains."""

import pytest

pytest.importorskip("pagewright.llm.catalog")

from pagewright.llm import mojibake  # noqa: E402

CLEAN = ["ÉLISE Été É", "Élise Navarro", "La página rápida, según él", "AÇÃO nova", "théière élégante", "größer", "½ off…", "Müller, 12 €"] * 30


def test_signs_that_stand_for_themselves():
    r = mojibake.Repairer(mojibake.train(CLEAN))
    for text in ("Loading… If nothing happens", "Checking that you are not a robot … Ref 3.", "AÇÃO Peletra", "12 € – ok", "Price 5 € … more…"):
        assert not r.repair(text)[0], text
    for text, chain in (("½ off…", "cp1252>mac"), ("la théière élégante", "cp1252>mac"), ("größer Müller", "cp1252>cp850")):
        assert r.repair(mojibake.garble(text, chain))[0], text


def test_strange_words():
    assert all(map(mojibake.strange, ["offÖ", "rÈveil", "nΣchtliche", "se±al", "cafÃ©"]))
    assert not any(map(mojibake.strange, ["café", "ÉLISE", "d’été", "Größe", "iPhone", "AÇÃO", "12€", "áb", "né​e", "…", ""]))
