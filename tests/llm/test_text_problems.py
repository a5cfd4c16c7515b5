"""The training-text operators: known cases, traps, brute force, edge cases, empty tables."""

import json
import os
import random
import re

import pytest
from pyspark.sql import types as T

pytest.importorskip("pagewright.llm.catalog")

from pagewright.llm import catalog, chunking, confusables, keyword_spam, leakage, mojibake, residue, tokenize  # noqa: E402


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_empty_tables(spark, tables):
    d = tables()
    for name, run in catalog.queries().items():
        if name != "p8_ids" or os.path.exists(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}"):
            assert run(spark, d).count() == 0, name


CLEAN = (
    ["La página nueva señala el tamaño", "Müller prüft die Größe", "Le café élimine l'été", "Köln überträgt", "niña año señas", "L'ÂGE DU fer", "SÃO Paulo – edição", "PÂTÉ maison, 3 €", "CRÈME brûlée", "¡Hola! ¿Sí?", "x² – ½ price", "“quoted” — the café’s"]
    + ["Каталог новый", "Μενού ημέρας", "カタログ", "Čaj – žlutý", "Ærø ½ l", "Ñandú", "© ÉDITIONS", "août précédent", "Außerdem: größer", "Étagère élégante", "théière réglable"]
) * 8


@pytest.fixture(scope="module")
def repairer():
    return mojibake.Repairer(mojibake.train(CLEAN))


@pytest.mark.parametrize("chain", [c for c in mojibake.CHAINS if mojibake.CHAINS[c][0][0] == "utf-8"])
def test_garbled_text_comes_back(repairer, chain):
    for text in ("La señal del año", "Größenverzeichnis", "dépliée et réglable", "12 € – ok"):
        bad = mojibake.garble(text, chain)
        if bad is not None:
            got = repairer.repair(f"<p>{bad} and more</p>")
            assert got[0] and got[2] == f"<p>{text} and more</p>", (chain, text, got)


@pytest.mark.parametrize("chain", [c for c in mojibake.CHAINS if mojibake.CHAINS[c][0][0] != "utf-8"])
def test_single_byte_chains(repairer, chain):
    bad = mojibake.garble("Le café précédent élimine la théière réglable", chain)
    assert repairer.repair(bad)[0], bad


def test_held_out_accuracy():
    """Trained on some texts, the classifier names garbled ones of others and leaves clean ones alone."""
    rng = random.Random(5)
    words = ["señal", "año", "größer", "Übersicht", "élégant", "dépôt", "niño", "prüft", "café", "théâtre", "mañana", "Straße", "où", "forêt", "corazón", "jamón"]
    make = lambda pool: " ".join(rng.choice(pool) for _ in range(6)) + " und la page"
    r = mojibake.Repairer(mojibake.train([make(words[:10]) for _ in range(300)] + CLEAN))
    clean = [make(words) for _ in range(300)]
    assert sum(r.repair(x)[0] for x in clean) <= 3
    for chain in mojibake.CHAINS:
        bad = [b for x in clean if (b := mojibake.garble(x, chain)) and b != x]
        assert sum(r.repair(x)[0] for x in bad) >= 0.97 * len(bad), chain


def test_what_is_not_garbled(repairer):
    for text in [*CLEAN, None, "", "plain", "an <code>Ã±</code> shown", "`Ã©` shown", "a" * 100_000]:
        assert not repairer.repair(text)[0], text
    assert repairer.repair("caf� au lait") == (True, "lost", None)
    assert repairer.repair("monta&Atilde;&plusmn;a")[0]


def test_p5_table(spark, tables):
    rows = [{"outcome_id": i, "raw_text": x} for i, x in enumerate([*CLEAN, None, "", "La seÃ±al", "cafÃ© <code>x</code>"])]
    pages = [{"page_id": 1, "cleaned_html": "<p>Gr├╢├ƒe</p>"}, {"page_id": 2, "cleaned_html": "<p>When <code>Ã±</code> is shown, Größe</p>"}, {"page_id": 3}, {"page_id": None, "cleaned_html": ""}]
    n = len(CLEAN)
    assert found(mojibake.p5_found(spark, tables(outcomes=rows, pages=pages))) == {("outcomes", n + 2), ("outcomes", n + 3), ("pages", 1)}


LOOKS_ALIKE = ["Ｂike", "２７.５０ USD", "café", "up​dates", "£﻿1", "a b", "a　b", "Jоrtra", "Τhe", "code А508", "Κelin bury", "100 K"]
FINE = ["Каталог новый", "Цена по запросу", "Μενού ημέρας Orel", "Каталог Falonlo", "👩‍🔧 set", "x² ½ ™", "“a” – b’s", "カタログ Mar", "Ærø", "", None, "tab\tline\nend", "α-carotene", "Größe", "नमस्‍ते"]


def test_kinds_of_look_alikes():
    s = confusables.Spelling()
    for text in LOOKS_ALIKE:
        assert s.kinds(text), text
        assert not s.kinds(s.plain(text)), (text, s.plain(text))
    for text in FINE:
        assert not text or not s.kinds(text), text
    assert s.plain("Ｊоrtra​ café") == "Jortra café"
    assert s.plain("Каталог а б") == "Каталог а б"


def test_p2_table(spark, tables):
    rows = [{"outcome_id": i, "raw_text": x, "value": "plain"} for i, x in enumerate([*LOOKS_ALIKE, *FINE, *CLEAN])] + [{"outcome_id": 999, "raw_text": "x", "value": "a b"}, {"outcome_id": 998, "raw_text": "VoilÃ  seÃ±al"}]
    got = found(confusables.p2_found(spark, tables(outcomes=rows)))
    assert got == {(i, "raw_text") for i in range(len(LOOKS_ALIKE))} | {(999, "value")}


RESIDUE = ["{{title}}", "{{{ a.b }}}", "by ${user.firstName} X", "<%= sku %>", "{% title %}", "#{DATE}", "%PAGE_TITLE%", "__DATE__", "@@sku@@", "[[plan]]", "*|NAME|*", "{sku}", "Lorem ipsum dolor sit amet.", "TODO: write", "undefined", "NaN", "[object Object]",
           "Title goes here", "Votre texte ici", "Hier steht Ihr Text", "404 – we could not find that page. Ref 3.", "Error 502: bad gateway", "Seite nicht gefunden (Fehler 404). Incident no. 4", "Please enable JavaScript to continue.", "Your browser does not run scripts; the page cannot be shown.", "blah blah blah"]
CONTENT = ["How to fix a 404 reply after moving a page.", "Where to enable JavaScript for Zel charts.", "What X does when a gateway answers with error 502 or 503.", "Placeholders and how Orenmere fills them.", "Access rights in X: who may view a page and who is denied.", "Why undefined values show up in reports, explained.",
           "A small margin of error", "https://a.test/%C3%A9%20x", "100% of 20% off", "f(x) = {1, 2}", "Kettle A404", "503", "Write '{{name}}' where the name stands", "", "no", "Designers use lorem ipsum in drafts of every kind they make."]


def test_residue_in_records():
    r = residue.Residue()
    for x in RESIDUE:
        assert r.record(json.dumps({"a": 1, "b": x, "c": None})), x
    for x in CONTENT:
        assert not r.record(json.dumps({"a": 1, "b": x, "c": True})), x
    assert r.record(None) is None and r.record("") is None and r.record("[]") is None
    assert r.record('{"a": {"b": ["{{x}}"]}}') == "slot" and r.record("{broken {{x}}") == "slot"


def test_p3_table(spark, tables):
    full = "<p>" + "The archive page keeps the date of the last visit. " * 8 + "</p>"
    pages = ["<article><h1>{{title}}</h1></article>", f"<h1>T</h1>{full}<pre><code>&lt;h1&gt;{{{{a}}}}&lt;/h1&gt;</code></pre>", "<main>Please enable JavaScript to continue.</main>", f"<noscript>Please enable JavaScript.</noscript>{full}",
             f"<p>Lorem ipsum dolor sit amet.</p>{full}", "<h1>T</h1><p>" + "Lorem ipsum dolor sit amet elit. " * 9 + "</p>", "<div class='m'><h2>Error 502: bad gateway</h2><p><a href='/'>Home</a></p></div>", None, "", "<p></p>", full * 400]
    rows = [{"record_id": f"r{i}", "payload": json.dumps({"a": x})} for i, x in enumerate([*RESIDUE, *CONTENT])] + [{"record_id": None, "payload": None}]
    d = tables(pages=[{"page_id": i, "cleaned_html": x} for i, x in enumerate(pages)], extracted_record=rows)
    assert found(residue.p3_found(spark, d)) == {("extracted_record", f"r{i}") for i in range(len(RESIDUE))} | {("pages", str(i)) for i in (0, 2, 5, 6)}


def texts_to_cut():
    rng = random.Random(2)
    words = ["page", "größer", "l'été", "表", "👩‍🔧", "🇫🇮", "é", "&amp;", "<b>x</b>"]
    for kind in ("prose", "rows", "base64", "one word", "spaces", "tags", "flags", "cjk"):
        n = rng.randrange(9_000, 40_000)
        yield kind, {
            "prose": lambda: "".join(f"<p>{' '.join(rng.choice(words) for _ in range(40))}. And so on.</p>\n" for _ in range(n // 300)),
            "rows": lambda: "".join(f"<tr><td>{i}</td></tr>" for i in range(n // 20)),
            "base64": lambda: "".join(rng.choice("ABCxyz019+/") for _ in range(n)),
            "one word": lambda: "x" * n, "spaces": lambda: " " * n, "tags": lambda: "<i>" * (n // 3), "flags": lambda: "🇫🇮" * (n // 2), "cjk": lambda: "表の記録。" * (n // 5),
        }[kind]()


@pytest.mark.parametrize("kind,text", list(texts_to_cut()), ids=lambda x: x if len(x) < 20 else "")
def test_pieces_fit_and_join(kind, text):
    out = chunking.pieces(text)
    assert all(len(x) <= chunking.LIMIT for _, x in out)
    assert all(b[1][: chunking.OVERLAP] == a[1][-chunking.OVERLAP :] for a, b in zip(out, out[1:]))
    assert out[0][1] + "".join(x[chunking.OVERLAP :] for _, x in out[1:]) == text
    ends = [s + len(x) for s, x in out[:-1]]
    assert not any(chunking.joined(text, e) for e in ends)
    if kind == "prose":
        assert all(text[:e].rstrip().endswith("</p>") for e in ends)


def test_an_edit_stays_local():
    text = "".join(f"<p>Sentence number {i * 7919 % 1009} of the page {i}.</p>\n" for i in range(2500))
    edited = text[:50_000] + "an edit " + text[50_000:]
    before, after = {x for _, x in chunking.pieces(text)}, [x for _, x in chunking.pieces(edited)]
    assert len(after) > 10 and sum(x not in before for x in after) <= 4


def test_p6_table(spark, tables):
    rows = [{"page_id": i, "cleaned_html": x} for i, x in enumerate([None, "", "x" * 8000, "x" * 8001, "😀" * 8000, "😀" * 8001, "a b " * 9000])]
    d = tables(pages=rows)
    assert found(chunking.p6_found(spark, d)) == {(3,), (5,), (6,)}
    rows = sorted((r.piece, r.start, r.text) for r in chunking.p6_pieces(spark, d).collect() if r.page_id == 6)
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[0][2] + "".join(r[2][200:] for r in rows[1:]) == "a b " * 9000


needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}"), reason="no vocabulary files")
ODD = ["", None, "<|endoftext|> I'LL we'll", "  a   b ", " \n\t x", "x" * 5000, "aAbB" * 500, "=" * 999, "²½ Ⅷ ٣ \x1c\x1d \x85", "👩‍🔧🇫🇮 ﷺ", "á 表の記録。", "trail ", " 　", "\x00�"]


@needs_vocabulary
def test_ids_are_the_librarys(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}")
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(161, 1000), rng.randrange(0x1F300, 0x1F600), 32])) for _ in range(300)) for _ in range(50)]
    got = {r.doc_id: r.ids for r in tokenize.p8_ids(spark, tables(documents=[{"doc_id": i, "text": x} for i, x in enumerate(texts)])).collect()}
    a = tokenize.Automaton(tokenize.compile_merges(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}"))
    for i, x in enumerate(texts):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids, repr(x)
        assert a.decode(got[i]) == (x or "")


@needs_vocabulary
def test_long_and_short_words_agree():
    a = tokenize.Automaton(tokenize.compile_merges(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}"))
    rng = random.Random(4)
    for _ in range(300):
        w = "".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(1, 60)))
        assert a.word(w) == a.long_word(w.encode())


def test_automaton_is_bpe(tmp_path):
    """Against merging by rank, on small vocabularies with equal and overlapping merges."""
    rng = random.Random(6)
    letters = {b: c for c, b in tokenize.byte_letters().items()}
    for _ in range(25):
        vocab, merges = {letters[b]: b for b in range(256)}, []
        for _ in range(30):
            known = [k for k in vocab if set(k) <= set("abc")]
            a, b = rng.choice(known), rng.choice(known)
            if a + b not in vocab and len(a + b) < 12:
                vocab[a + b] = len(vocab)
                merges.append(f"{a} {b}")
        (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
        m = tokenize.Automaton(tokenize.compile_merges(str(tmp_path / "v.json")))
        rank = {tuple(x.split()): i for i, x in enumerate(merges)}
        for _ in range(40):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
            parts = list(w)
            while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
                best = min(pairs)[0]
                out, i = [], 0
                while i < len(parts):
                    if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == best:
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert m.word(w) == [vocab[p] for p in parts], (w, merges)


def brute_leaks(docs, items):
    words = re.compile(r"[^\W_]+").findall
    owners: dict = {}
    for i, x in items:
        w = words((x or "").lower())
        for k in range(len(w) - 11):
            owners.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, x in docs:
        w = words((x or "").lower())
        out |= {(d, i) for k in range(len(w) - 11) for i in owners.get(tuple(w[k : k + 12]), ())}
    return out


def test_p9_is_brute_force(spark, tables):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = [(100, None), (101, ""), (102, "w1 " * 5000)]
    for d in range(40):
        body = [rng.choice(vocabulary) for _ in range(60)]
        source = items[rng.randrange(12)][1].split()
        k, n = rng.randrange(18), rng.choice([10, 11, 12, 13, 20])
        passage = source[k : k + n]
        docs.append((d, " ".join(body[:20]) + ", " + " -- ".join(passage).upper() + "\n" + " ".join(body[20:])))
    docs += [(200, items[3][1]), (200 + 1, items[3][1]), (202, " ".join(items[4][1].split()[15:] + ["x"] + items[4][1].split()[:15]))]
    d = tables(documents=[{"doc_id": i, "text": x} for i, x in docs], benchmark=[{"item_id": i, "text": x} for i, x in items])
    got = found(leakage.p9_found(spark, d))
    assert got == brute_leaks(docs, items) and {(200, 3), (201, 3), (202, 4)} <= got
    whole = {(r.doc_id, r.item_id): r.coverage for r in leakage.leaks(spark, spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert whole[202, 4] == 1.0  # the halves stand in another order


def test_tiles_are_longest_first():
    a, b = list("abcdefgh" * 2), list("xxabcdefghyyabc")
    assert leakage.tiles(a, b, 3) == [(0, 2, 8), (8, 12, 3)]


NOUNS = ["kettle", "tripod", "backpack", "speaker"]
PROSE = "The archive page keeps the date of the last visit. A careful reader compares the comparison chart, and the release returns the discount for schools. Why does Marivo matter? Because the desk lamp renames a short summary of each page. "


def spam_texts():
    rng = random.Random(8)
    yield " | ".join(f"{rng.choice(['buy', 'cheap', 'sale'])} {rng.choice(NOUNS)}" for _ in range(80))
    yield "\n".join(f"{rng.choice(NOUNS)} in {rng.choice(['Oslo', 'Bern', 'Rome'])}" for _ in range(60))
    yield "#" + " #".join(rng.choice(NOUNS) for _ in range(50))
    yield "\n".join(f"https://x{i}.example/a-{i} {rng.choice(NOUNS)}" for i in range(30))
    yield "\n".join(f"- [{rng.choice(NOUNS)} {i}](https://x{i}.example/b)" for i in range(30))
    yield " ".join(f"{rng.choice(['Our', 'Best', 'The'])} slim kettle is the {rng.choice(['best', 'top'])} slim kettle for slim kettle {rng.choice(['fans', 'shops'])}." for _ in range(40))
    yield PROSE[:60] + "\n" + ", ".join(rng.choice(NOUNS) for _ in range(120))


def honest_texts():
    yield PROSE * 3
    yield PROSE + "\nTags: a, b, c, d, e, f, g\nhttps://x.example/1\nhttps://x.example/2"
    yield "\n".join(f"{i}.{i % 3}: The release number {i} moves the {'old' if i % 2 else 'new'} price table, says Ada {i * 37 % 101}." for i in range(30))
    yield "\n".join(f"const v{i} = load(\"v{i}\", {i});" for i in range(40))
    yield "Oh the river, it runs.\nAnd we sing along.\n" * 30 + PROSE
    yield from ("", None, "   ", "!" * 500, "0" * 400, " ".join(str(7**i) for i in range(40)), "表の記録は保管されます。" * 40)


def test_p10_table(spark, tables):
    spam, honest = list(spam_texts()), list(honest_texts())
    background = [PROSE.replace("visit", f"visit {i}").replace("chart", f"chart of {i * 31 % 97}") + f"It's {i} minutes from Oslo, and the field editor splits list {i * 7}." for i in range(60)]
    docs = [{"doc_id": i, "text": x, "lang": "en"} for i, x in enumerate([*spam, spam[0], *honest, *background])]
    got = found(keyword_spam.p10_found(spark, tables(documents=docs)))
    assert got == {(i,) for i in range(len(spam) + 1)}


def test_queries_need_no_session():
    assert {f"p{n}_found" for n in (2, 3, 5, 6, 9, 10)} | {"p8_ids"} <= set(catalog.queries())
    assert isinstance(residue.residue.returnType, T.StringType)
