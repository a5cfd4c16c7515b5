"""Keyword pages: repeated rows, ids that are null, scripts without blanks, texts that only look like lists."""

import random

import pytest

pytest.importorskip("pagewright.llm.catalog")

from pagewright.llm import keyword_spam  # noqa: E402

NOUNS = ["kettle", "tripod", "backpack", "speaker", "shelf", "lamp"]
PLACES = ["Oslo", "Bern", "Rome", "Lima", "Kyiv"]


def prose(i):
    rng = random.Random(i)
    verbs, things = ["keeps", "moves", "renames", "compares"], ["archive page", "careful reader", "release", "field editor", "support desk", "price table"]
    return " ".join(f"The {rng.choice(things)} {rng.choice(verbs)} the {rng.choice(things)} of {rng.choice(PLACES)}, and page {rng.randrange(900)} {rng.choice(verbs)} {rng.randrange(90)} parts." for _ in range(9))


def test_a_repeated_row_counts_once(spark):
    """A document with a third of redundant text stays one that has a third of it, however often its row comes."""
    listed = " | ".join(f"buy {NOUNS[i % 6]} {PLACES[i % 5]}" for i in range(22))
    rows = [(i, prose(i), "en") for i in range(80)] + [(900, prose(900) + "\n" + listed, "en")] * 3 + [(901, listed, "en")] * 2 + [(None, listed, None), (None, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = keyword_spam.scored(docs).collect()
    assert len(got) == len(rows)
    assert {r.spam for r in got if r.doc_id == 900} == {len(listed)}
    assert {r.doc_id for r in got if 2 * r.spam > r.size} == {901, None}


def test_lists_of_other_scripts_and_code(spark):
    rng = random.Random(3)
    goods = ["ケトル", "三脚", "鞄", "時計", "棚"]
    japanese = "、".join(rng.choice(goods) for _ in range(160))
    code = "\n".join(f"if (row[{i}] > {i * 7}) return load(\"{rng.choice(NOUNS)}\", {i});" for i in range(40))
    poem = "\n".join(f"{rng.choice(NOUNS)} under {rng.choice(PLACES)}" for _ in range(4)) + "\n" + prose(7)
    rows = [(i, prose(i), "en") for i in range(80)] + [(100, japanese, "ja"), (101, code, None), (102, poem, "en"), (103, "7 12 9 " * 200, None), (104, "-" * 900, "en"), (105, prose(5) + "\nTags: a, b, c", "en")]
    got = keyword_spam.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in got if 2 * r.spam > r.size} == {100}


def test_no_list_of_separators():
    """The same words are found whatever stands between them."""
    for sign in (" | ", ", ", " ~ ", " :: ", "\n", " ❖ ", " "):
        rng = random.Random(5)
        text = sign.join(f"{rng.choice(['buy', 'cheap', 'best'])} {rng.choice(NOUNS)} {rng.choice(PLACES)}" for _ in range(60))
        (block,) = {b[2:] for b in keyword_spam.Looker().look(text)[:1]}
        ended, ratio, form, listed, _ = block
        assert listed and not ended and (ratio / 0.46) * (form / 0.7) < keyword_spam.REDUNDANT, (sign, ratio, form)
