"""Visually identical text with different characters, brought to one form.

Every letter has a set of scripts: its own, widened as writing systems mix them (Han, Kana and Hangul), and those in which a
letter looks like it. The own sets of a token's letters are intersected; where nothing is left, the token is of mixed
scripts, and the intersection of the widened sets names the scripts in which all of it could be written. The token gets the
spelling of one of them: Latin in Latin text, else the script of the words around it, else that of most of its letters. A
token of one script that is wholly of look-alikes is whole-script confusable where the text around it is Latin. Full-width
forms, separate accents, zero-width signs and odd blanks are normalized after that, and so are styled letters, ligatures and
phonetic letters, whose plain forms come from Unicode's own decompositions and names. Texts garbled by a wrong decoding are
left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.mojibake import Repairer, fit
from pagewright.sources.tables import table

# Letters of other scripts that look like a Latin letter, beside it.
LOOKALIKES = {
    "Cyrillic": ("аАВсСԁеЕһНіІїјЈкКӏЅѕМоОрРԛТԜԝуУхХѵΥЗԌҮүԚ", "aABcCdeEhHiIïjJkKlSsMoOpPqTWwyYxXvY3GYyQ"),
    "Greek": ("αΑΒϲϹΕΗιΙϳͿκΚΜΝνοΟΡρΤυΥΧΖ", "aABcCEHiIjJkKMNvoOPpTuYXZ"),
    "Armenian": ("օՕսՍհոզցԼ", "oOuUhnqgL"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᎻᎥᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHiJKLMPRSTVWZ"),
}
#: Greek small letters that stand alone as signs of mathematics and science.
SYMBOLS = "αικνρυ"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ZERO = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
LATIN, EMOJI, CJK = "Latin", "[☀-➿\U0001f000-\U0001faff←-⇿⬀-⯿\ufe0f\u200d♀♂\U0001f3fb-\U0001f3ff]", "[぀-ヿ㐀-鿿가-힯]"
JOINING = ("ARABIC", "SYRIAC", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "MONGOLIAN", "MYANMAR")


def script(c: str) -> str | None:
    """Script of a letter by its Unicode name; None for signs, digits and letters common to all."""
    if not c.isalpha() or c in "ªºµ":
        return None
    if c < "ɐ":
        return LATIN
    first = unicodedata.name(c, "").split(" ")
    word = first[1] if first[0] in ("FULLWIDTH", "HALFWIDTH") and len(first) > 1 else first[0]
    return {"KELVIN": LATIN, "ANGSTROM": LATIN, "CJK": "Han"}.get(word, word.capitalize())


#: Writing systems that take letters of several scripts.
SYSTEMS = {"Han": {"Han", "Japanese", "Korean", "Bopomofo"}, "Hiragana": {"Hiragana", "Katakana", "Japanese"}, "Katakana": {"Hiragana", "Katakana", "Japanese"}, "Katakana-hiragana": {"Hiragana", "Katakana", "Japanese"},
           "Hangul": {"Hangul", "Korean"}, "Bopomofo": {"Bopomofo"}}
#: Kinds that make a text a case of p2_found; ``style`` and ``other-letter`` are normalized as well.
CASES = ("width", "accent", "zero-width", "blank", "letter")


def styled() -> dict[str, str]:
    """Letters that are plain ones in another style, and what they are, by rule: font variants and ligatures by their
    decomposition, small capitals, script letters and alpha of the phonetic alphabet by their names."""
    out = {}
    for n in [*range(0x0250, 0x02B0), *range(0x1D00, 0x1D80), *range(0x2100, 0x2150), *range(0xFB00, 0xFB07), *range(0x1D400, 0x1D800)]:
        c = chr(n)
        name, kind = unicodedata.name(c, ""), unicodedata.decomposition(c)
        if m := re.fullmatch(r"LATIN (?:LETTER SMALL CAPITAL|SMALL LETTER SCRIPT) ([A-Z])|LATIN SMALL LETTER (A)LPHA", name):
            out[c] = (m[1] or m[2]).lower()
        elif kind.startswith("<font>") or kind.startswith("<compat>") and "LIGATURE" in name:
            plain = unicodedata.normalize("NFKC", c)
            if plain.isalnum():
                out[c] = plain
    return out


class Spelling:
    """Finds and normalizes the forms; remembers nothing between texts but tables."""

    def __init__(self):
        self.latin = {c: x for here, there in LOOKALIKES.values() for c, x in zip(here, there, strict=True)}
        self.token = re.compile(r"[^\W_]+(?:[\u0300-\u036f" + ZERO + r"]+[^\W_]*)*")
        self.odd = re.compile(f"[{BLANKS}{ZERO}]")
        self.wide = re.compile("[！-～￠-￦]")
        self.mark = re.compile("[\u0300-\u036f\u0653-\u0655\u3099\u309a\u1ab0-\u1aff]")
        self.kelvin = re.compile("[\u212a\u212b]")
        self.foreign = re.compile("[\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u13a0-\u13fd]")
        #: Latin letter -> script -> the first letter of that script that looks like it.
        self.like: dict[str, dict[str, str]] = {}
        for name, (here, there) in LOOKALIKES.items():
            for c, x in zip(here, there, strict=True):
                self.like.setdefault(x, {LATIN: x}).setdefault(name, c)
        self.style = styled()
        # Ranges, as a class of a thousand single letters is slow; what of them is no styled letter is left as it is.
        self.styles = re.compile("[\u0250-\u02af\u1d00-\u1d7f\u2100-\u214f\ufb00-\ufb06\U0001d400-\U0001d7ff]")
        self.known: dict[str, tuple[frozenset, frozenset]] = {}

    def zero_width(self, text: str) -> list[int]:
        """Places of zero-width signs that are no joiner of an emoji or of a script that joins."""
        out = []
        for m in re.finditer(f"[{ZERO}]", text):
            i, c = m.start(), m[0]
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if c == "‍" and re.match(EMOJI, before or " ") and re.match(EMOJI, after or " "):
                continue
            if c in "‌‍‎‏؜" and any(unicodedata.name(x, "").startswith((*JOINING, "HEBREW")) for x in (before, after) if x):
                continue
            out.append(i)
        return out

    def scripts(self, c: str) -> tuple[frozenset, frozenset]:
        """(own scripts, those and the scripts in which a letter looks like it); both empty for what is no letter."""
        if c not in self.known:
            own = script(c)
            mine = frozenset(SYSTEMS.get(own, {own}) if own else ())
            self.known[c] = mine, mine | frozenset(self.like.get(self.latin.get(c, c), ())) if mine else mine
        return self.known[c]

    def spelled(self, token: str, target: str) -> str:
        """A token in the letters of one script, as far as they differ from it."""
        return "".join(c if not (x := self.scripts(c))[0] or target in x[0] else self.like.get(self.latin.get(c, c), {}).get(target, c) for c in token)

    def borrowed(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, spelling, script) of the tokens with letters borrowed from another script."""
        if not self.foreign.search(text):
            return []
        tokens, own, anchors = [], set(), set()
        for m in self.token.finditer(text):
            letters = [c for c in unicodedata.normalize("NFKC", m[0]) if self.scripts(c)[0]]
            if not letters:
                continue
            sets = [self.scripts(c) for c in letters]
            single, could = frozenset.intersection(*(x for x, _ in sets)), frozenset.intersection(*(x for _, x in sets))
            if any(LATIN in x for x, _ in sets):
                own.add(LATIN)
            if LATIN not in could:  # letters that are of one script alone anchor the text in it
                anchors |= {s for c in letters if self.latin.get(c, c) not in self.like for s in self.scripts(c)[0] if s != LATIN}
            tokens.append((m, sets, single, could))
        out = []
        for m, sets, single, could in tokens:
            if LATIN in single or not could:
                continue
            if not single:
                count = {s: sum(s in x for x, _ in sets) for s in could}
                around = [s for s in sorted(could - {LATIN}) if s in anchors]
                target = LATIN if LATIN in could and not (around and count[around[0]] > count[LATIN] and self.alone(tokens, m)) else (around or sorted(could, key=lambda s: (-count[s], s)))[0]
                out.append((m.start(), m.end(), self.spelled(m[0], target), target))
            elif LATIN in could and not (single & anchors) and (LATIN in own or any(c.isdigit() for c in m[0])) and m[0].strip(ZERO) not in SYMBOLS:
                out.append((m.start(), m.end(), self.spelled(m[0], LATIN), LATIN))
        return out

    @staticmethod
    def alone(tokens: list, m: re.Match) -> bool:
        """Whether no other token of the text is wholly Latin."""
        return not any(LATIN in single for other, _, single, _ in tokens if other is not m)

    def kinds(self, text: str) -> list[str]:
        """Which odd forms a text holds: width, accent, zero-width, blank, letter (borrowed in Latin text), other-letter
        (borrowed in text of another script), style."""
        out = []
        if self.wide.search(text):
            signs = self.wide.findall(text)
            if any(c.isalnum() for c in signs) or not re.search(CJK, text):
                out.append("width")
        if self.mark.search(text):
            for m in re.finditer(r"[^\W\d_](?:" + self.mark.pattern + ")+", text):
                if len(unicodedata.normalize("NFC", m[0])) < len(m[0]):
                    out.append("accent")
                    break
        if self.odd.search(text):
            if any(c in BLANKS for c in text):
                out.append("blank")
            if self.zero_width(text):
                out.append("zero-width")
        targets = {t for *_, t in self.borrowed(text)}
        if self.kelvin.search(text) or LATIN in targets:
            out.append("letter")
        if targets - {LATIN}:
            out.append("other-letter")
        if self.styles.search(text) and any(c in self.style for c in self.styles.findall(text)):
            out.append("style")
        return out

    def plain(self, text: str) -> str:
        """The one form of a text: letters of one script a word, plain styles, widths and blanks, composed accents, no zero width."""
        kinds = self.kinds(text)
        if "letter" in kinds or "other-letter" in kinds:
            for start, end, new, _ in reversed(self.borrowed(text)):
                text = text[:start] + new + text[end:]
        if "style" in kinds:
            text = self.styles.sub(lambda m: self.style.get(m[0], m[0]), text)
        if "width" in kinds:
            text = self.wide.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
        if "zero-width" in kinds:
            drop = set(self.zero_width(text))
            text = "".join(c for i, c in enumerate(text) if i not in drop)
        if "blank" in kinds:
            text = re.sub(f"[{BLANKS}]", " ", text)
        return unicodedata.normalize("NFC", text) if kinds else text


def spelling_udf(spark, model: dict):
    """(text) -> struct(kinds, plain); garbled texts have no kinds and stay as they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("kinds array<string>, plain string")
    def spelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        spelling, repairer = Spelling(), Repairer(shared.value)
        for batch in batches:
            rows = []
            for text in batch:
                kinds = spelling.kinds(text) if isinstance(text, str) and not text.isascii() else []
                if kinds and repairer.repair(text)[0]:
                    kinds = []
                rows.append((kinds, spelling.plain(text) if kinds else text))
            yield pd.DataFrame(rows, columns=["kinds", "plain"])

    return spelled


def _spelled(spark, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "outcomes")
    model = fit(outcomes.select(F.col("raw_text").alias("text")))
    cols = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in ("raw_text", "value")])
    texts = outcomes.select("outcome_id", F.explode(F.filter(cols, lambda x: F.rlike(x["text"], F.lit(r"[^\x00-\x7f]")))).alias("t"))
    return texts.select("outcome_id", "t.col", "t.text").withColumn("s", spelling_udf(spark, model)("text"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """outcome_id, col of every text with a form that looks like another. Null, empty and ASCII texts are no cases."""
    return _spelled(spark, sf_dir).filter(F.arrays_overlap("s.kinds", F.array(*[F.lit(k) for k in CASES]))).select("outcome_id", "col")


def p2_normalized(spark, sf_dir: str) -> DataFrame:
    """outcome_id, col, kinds, text in its one form, for every text that changes."""
    return _spelled(spark, sf_dir).filter(F.size("s.kinds") > 0).select("outcome_id", "col", "s.kinds", F.col("s.plain").alias("text"))
