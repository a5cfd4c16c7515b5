"""Cuts beside long tags, comments and entities."""

import random
import re

import pytest

pytest.importorskip("pagewright.llm.catalog")

from pagewright.llm import chunking  # noqa: E402


@pytest.mark.parametrize("size", [500, 2_100, 4_500, 7_000, 7_790])
def test_long_tags_stay_whole(size):
    for seed in range(40):
        rng = random.Random(seed)
        prose = lambda n: "".join(f"<p>The page {rng.randrange(10**6)} keeps its date, and {rng.randrange(99)} more.</p>\n" for _ in range(n // 50))
        kind = rng.choice(['<img alt="{}">', "<!-- {} -->", "<a href='/{}'>"])
        text = prose(rng.randrange(3_000, 9_000)) + kind.format(" ".join("x" * rng.randrange(3, 9) for _ in range(size // 7))[: size - 12]) + prose(6_000)
        spans = [m.span() for m in re.finditer(r"<!--.*?-->|<[^<>]*>", text)]
        out = chunking.pieces(text)
        assert out[0][1] + "".join(x[chunking.OVERLAP :] for _, x in out[1:]) == text and all(len(x) <= chunking.LIMIT for _, x in out)
        for end in chunking.cuts(text)[:-1]:
            assert not any(a < end < b for a, b in spans), (seed, end)


def test_a_tag_longer_than_a_piece_is_cut():
    text = "<p>" + "word " * 900 + "</p><img alt='" + "y " * 9_000 + "'>" + "<p>" + "word " * 900
    out = chunking.pieces(text)
    assert out[0][1] + "".join(x[chunking.OVERLAP :] for _, x in out[1:]) == text and all(len(x) <= chunking.LIMIT for _, x in out)
