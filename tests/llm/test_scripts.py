"""Tokens of mixed scripts, whatever the script of the text, and styled letters."""

import pytest

pytest.importorskip("pagewright.llm.catalog")

from pagewright.llm.confusables import CASES, Spelling  # noqa: E402


@pytest.mark.parametrize("text,plain,case", [
    ("Прoект готов", "Проект готов", False), ("Jоrtra", "Jortra", True), ("ɑpple", "apple", False), ("ɡoogle", "google", False), ("ᴀbc", "abc", False), ("𝐇ello 𝟗", "Hello 9", False), ("ﬁle", "file", False),
    ("Μενoύ ημέρας", "Μενού ημέρας", False), ("the Κelin of Ulo", "the Kelin of Ulo", True), ("Тhe end", "The end", True), ("東京カメラ", "東京カメラ", False), ("x² ½ ™ Ⓐ", "x² ½ ™ Ⓐ", False), ("Дoж", "Дож", False), ("日本語とカナ Latin", "日本語とカナ Latin", False),
])
def test_one_spelling(text, plain, case):
    s = Spelling()
    assert s.plain(text) == plain
    assert bool(set(s.kinds(text)) & set(CASES)) == case
    assert not s.kinds(s.plain(text))
