"""Garbled places inside long tokens, and texts without blanks between words."""

import pytest

pytest.importorskip("pagewright.llm.catalog")

from pagewright.llm import mojibake  # noqa: E402

JAPANESE = "商品の説明と利用規約については以下のページをご覧ください。新しいカタログは毎月公開されます、"
CLEAN = ["La señal del año", "Größe und Übersicht", "Le café élégant", "dépliée et réglable", JAPANESE, "価格は税込×2…「送料」—無料"] * 40


@pytest.fixture(scope="module")
def repairer():
    return mojibake.Repairer(mojibake.train(CLEAN))


@pytest.mark.parametrize("before", [0, 1, 20, 400])
@pytest.mark.parametrize("chain", ["utf8>cp1252", "utf8>latin1", "utf8>mac"])
def test_one_place_in_text_without_blanks(repairer, before, chain):
    right = JAPANESE * before + "カタログ" + JAPANESE * 3
    bad = JAPANESE * before + mojibake.garble("カタログ", chain) + JAPANESE * 3
    assert not repairer.repair(right)[0]
    got = repairer.repair(f"<p>{bad}</p>")
    assert got[0] and got[2] == f"<p>{right}</p>"


@pytest.mark.parametrize("before", [3, 30, 3000])
def test_one_place_in_a_long_token_of_latin_letters(repairer, before):
    right = "café-où-" * before + "señal" + "-año" * before
    bad = right.replace("señal", mojibake.garble("señal", "utf8>cp1252"))
    assert not repairer.repair(right)[0]
    got = repairer.repair(bad)
    assert got[0] and got[2] == right


def test_stretches_leave_out_ascii_and_foreign_signs_only():
    token = "日本é語" + "ab-ñ" * 200 + "Ã©" * 90 + "本"
    parts = dict(mojibake.stretches(token))
    assert "Ã©" * 90 in "".join(parts.values())
    assert all(token.startswith(p, at) for at, p in parts.items())
    read = {i for at, p in parts.items() for i in range(at, at + len(p))}
    assert all(token[i].isascii() or token[i] in "日本語" for i in set(range(len(token))) - read)


def test_full_width_letters_are_latin_text():
    assert list(mojibake.stretches("ｄéｐôｔ")) == [(0, "ｄéｐôｔ")]
