"""Items whose ids repeat or are null; tiles against brute force; passages in another order; both plans."""

import random
import time

import pytest

pytest.importorskip("pagewright.llm.catalog")

from pagewright.llm import leakage  # noqa: E402


def passage(name):
    return " ".join(f"{name}{i}" for i in range(12))


def test_every_text_of_an_item_is_searched_for(spark, tables):
    big = 2**53 + 1
    items = [(7, "a"), (7, "b"), (7, "c"), (None, "d"), (None, "e"), (big, "f"), (8, "b"), (7, "b")]
    benchmark = [{"item_id": i, "text": passage(x)} for i, x in items] + [{"item_id": 9}, {"item_id": None}, {"item_id": 7, "text": ""}]
    documents = [{"doc_id": k, "text": f"so {passage(x)} it is"} for k, x in enumerate("abcdefg")] + [{"doc_id": 99}, {"doc_id": None, "text": passage("f")}, {"doc_id": 0, "text": f"so {passage('a')} it is"}]
    want = {(k, i) for k, x in enumerate("abcdefg") for i, y in items if x == y} | {(None, big)}
    d = tables(documents=documents, benchmark=benchmark)
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    for block in (leakage.BLOCK, 0):  # broadcast, join
        got = [(r.doc_id, r.item_id) for r in leakage.leaks(spark, read("documents"), read("benchmark"), block).collect()]
        assert len(got) == len(want) and set(got) == want, block
    report = {r.item_id: (r.documents, r.coverage) for r in leakage.p9_report(spark, d).collect()}
    assert report == {7: (3, 1.0), None: (2, 1.0), big: (2, 1.0), 8: (1, 1.0)}


def brute(a, b, least):
    """Greedy tiling by looking at every pair of places, again and again."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        out.append(best)
        used_a |= set(range(best[0], best[0] + best[2]))
        used_b |= set(range(best[1], best[1] + best[2]))


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnop"])
def test_tiles_are_those_of_brute_force(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(0, 50))] for _ in "ab")
        if rng.random() < 0.5 and len(b) > 12:
            a[5:5] = b[6:] + b[:6]
        for least in (2, 4):
            assert leakage.tiles(a, b, least) == brute(a, b, least)


def test_texts_that_only_repeat_take_no_longer():
    a, b = ["w"] * 40_000, ["w"] * 3_000
    began = time.time()
    assert leakage.tiles(a, b) == [(0, 0, 3_000)]
    a, b = (["x", "y"] * 20_000), (["y", "x"] * 500)
    assert sum(t[2] for t in leakage.tiles(a, b)) == 1_000
    assert time.time() - began < 5


def test_passages_in_another_order(spark, tables):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    items = [[rng.choice(words) for _ in range(90)] for _ in range(30)]
    docs, want = [], {}
    for i, w in enumerate(items):
        cuts = [w[0:30], w[30:60], w[60:90]]
        rng.shuffle(cuts)
        noise = lambda: [rng.choice(words) for _ in range(8)]
        kept = cuts[: 1 + i % 3]
        docs.append({"doc_id": i, "text": " ".join(x for c in kept for x in noise() + c) + " end."})
        if len(kept) > 1:
            want[i, i] = 30 * len(kept)
    d = tables(documents=docs, benchmark=[{"item_id": i, "text": " ".join(w)} for i, w in enumerate(items)])
    got = {(r.doc_id, r.item_id): r.words for r in leakage.p9_covered(spark, d).collect()}
    assert got.keys() == want.keys()
    assert all(n <= got[k] <= n + 4 for k, n in want.items())  # noise beside a passage may agree by chance


def test_both_plans_agree(spark, tables):
    """Searches take every document; the kept seeds lose no pair that brute force finds."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randrange(5, 60))] for _ in range(40)]
    docs = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        w = rng.choice(items)
        k = rng.randrange(len(w))
        docs.append({"doc_id": i, "text": " ".join(body[:20] + w[k : k + rng.choice([11, 12, 13, 30])] + body[20:])})
    docs += [{"doc_id": 200 + i, "text": " ".join(items[0])} for i in range(60)]
    d = tables(documents=docs, benchmark=[{"item_id": i, "text": " ".join(w)} for i, w in enumerate(items)])
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    a, b = ({tuple(r) for r in leakage.leaks(spark, read("documents"), read("benchmark"), block).collect()} for block in (leakage.BLOCK, 0))
    assert a == b and len(a) > 60
