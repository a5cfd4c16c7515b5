"""Text that was decoded with the wrong encoding: find it, name the chain, give the text back.

A multinomial classifier over hashed byte bigrams tells, for every token with a sign beyond ASCII, which chain of wrong
decodings made it (or none). It is trained on a bounded sample of the table's own texts, garbled on purpose by every
chain. A predicted chain counts only if it can be inverted strictly: every sign goes back to a byte of the wrong
encoding, and the bytes are valid in the right one.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.tables import table

#: Lines of a table that, garbled on purpose, train the classifier, and the most signs that such a line has: the only sample
#: in this module, and its bound.
TRAIN_ROWS, TRAIN_SIGNS = 3000, 2000
BUCKETS = 1 << 13
#: Chain name -> steps; a step (right, wrong) means bytes of ``right`` were read as ``wrong``, in that order.
CHAINS = {
    "utf8>cp1252": (("utf-8", "web1252"),),
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>cp1252 twice": (("utf-8", "web1252"), ("utf-8", "web1252")),
    "utf8>latin1 twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8>mac": (("utf-8", "mac_roman"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "cp1252>mac": (("web1252", "mac_roman"),),
    "cp1252>cp437": (("web1252", "cp437"),),
    "cp1252>cp850": (("web1252", "cp850"),),
}
CLEAN = "clean"
#: Signs that a single-byte chain may have hidden; a word never holds a hidden blank or currency letter.
SIGNS = "–—‘’“”„…€£½¼¾²³°™©®«»¿¡·×§"
CODE = r"(?is)<(code|pre|samp|kbd|tt)\b[^>]*>.*?</\1\s*>|`[^`\n]+`"
TOKEN = r"[^\x00-\x20<>\"()\[\]{},;/|=]*[^\x00-\x7f][^\x00-\x20<>\"()\[\]{},;/|=]*"
RUN = r"[^\x00-\x7f]+"
#: Letters of scripts without blanks between words, and with them their punctuation and full-width forms. No
#: chain leaves one of them, so garbled text ends there. Full-width letters alone are Latin text.
SCRIPT = r"\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3005-\u3007\u3021-\ud7ff\uf900-\ufaff\uff66-\uffdc\U00020000-\U0003ffff"
FOREIGN = rf"[{SCRIPT}\u3000-\u3020\ufe30-\ufe4f\uff00-\uffef]+"
#: Signs of the longest word; what is longer is read run by run of non-ASCII signs, each with the letters beside it.
WORD = 40
BESIDE = r"[\x00-\x7f]{0,6}[^\x00-\x7f]+[\x00-\x7f]{0,6}"


def _to_bytes(text: str, codec: str) -> bytes | None:
    """Bytes of a text; web1252 is cp1252 with its five gaps filled as browsers do."""
    try:
        if codec != "web1252":
            return text.encode(codec)
        return b"".join(bytes([ord(c)]) if c in "\x81\x8d\x8f\x90\x9d" else c.encode("cp1252") for c in text)
    except UnicodeError:
        return None


def _to_text(data: bytes, codec: str) -> str | None:
    try:
        if codec != "web1252":
            return data.decode(codec)
        return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)
    except UnicodeError:
        return None


def garble(text: str, chain: str) -> str | None:
    """The text as the chain leaves it; None where it can't be written so."""
    for right, wrong in CHAINS[chain]:
        data = _to_bytes(text, right)
        text = None if data is None else _to_text(data, wrong)
        if text is None:
            return None
    return text


def _likely(text: str) -> bool:
    """No control signs, gaps of Unicode, stray marks or private signs."""
    return bool(text) and all(unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs", "Mn", "Me", "Lo") or c in "\n\r\t" or "぀" <= c <= "鿿" or "가" <= c <= "힣" or c in "ªº" for c in text)


def invert(token: str, chain: str) -> str | None:
    """The token before the chain, or None if it is not strictly decodable. UTF-8 chains are inverted run by run of
    non-ASCII signs, as only those hold its bytes; runs that are no UTF-8 stay, but one at least must be."""
    steps = CHAINS[chain][::-1]
    if steps[0][0] != "utf-8":
        data = _to_bytes(token, steps[0][1])
        text = None if data is None else _to_text(data, steps[0][0])
        return text if text is not None and text != token and all(c < "\x7f" or c.isalpha() or c in SIGNS for c in text) else None
    hit = False

    def back(m) -> str:
        nonlocal hit
        text = m[0]
        for right, wrong in steps:
            data = _to_bytes(text, wrong)
            text = None if data is None else _to_text(data, right)
            if text is None:
                return m[0]
        if _likely(text):
            hit = True
            return text
        return m[0]

    out = re.sub(RUN, back, token)
    return out if hit else None


def stretches(token: str) -> list[tuple[int, str]]:
    """(position, part) of a token, so that a garbled place is not outweighed by what stands around it: the parts between
    signs of scripts without blanks, and of a part longer than WORD each run of non-ASCII signs. What a chain made of one
    sign is never cut apart, and only ASCII and foreign signs are left out."""
    out, at = [], 0
    for k, part in enumerate(re.split(f"({FOREIGN})", token) if re.search(f"[{SCRIPT}]", token) else [token]):
        if k % 2 == 0 and not part.isascii():
            out += [(at, part)] if len(part) <= WORD else [(at + m.start(), m[0]) for m in re.finditer(BESIDE, part)]
        at += len(part)
    return out


def strange(token: str) -> bool:
    """Whether a token has a sign that no word has there: a capital beyond ASCII after a small letter, or a symbol between two
    letters. Words do not; many garbled ones do."""
    for i in range(1, len(token)):
        a, b = token[i - 1], token[i]
        if b > "\x7f" and a.isalpha():
            if b.isupper():
                if a.islower():
                    return True
            elif not b.isalnum() and b not in "’‘‐‑–·" and unicodedata.category(b)[0] not in "MCZ" and i + 1 < len(token) and token[i + 1].isalpha():
                return True
    return False


def features(token: str) -> np.ndarray:
    """Hashed byte bigrams of a token in UTF-8, with its ends: once as it stands, once with plain letters by case only."""
    shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "0", token)))
    out = []
    for text, salt in ((token.lower() if token.isascii() else token, 0), (shape, 40503)):
        data = np.frombuffer(bytes([2]) + text.encode("utf-8", "replace") + bytes([3]), np.uint8).astype(np.int64)
        a, b = data[:-1], data[1:]
        out.append(((a * 257 + b * 7919 + salt) % BUCKETS)[(a > 127) | (b > 127) | (a < 4) | (b < 4)])
    return np.concatenate(out)


def train(texts: list[str]) -> dict:
    """Log probabilities by class and bucket from a bounded sample of texts, each garbled by every chain."""
    tokens: Counter = Counter()
    for text in texts:
        found = re.findall(TOKEN, html.unescape(text))
        if not any(map(strange, found)):  # lines that are garbled themselves teach nothing
            tokens.update(found)
    clean = {t: math.log1p(n) for t, n in tokens.items() if "�" not in t and not re.search("[\x80-\x9f]", t) and not any(invert(t, c) for c in CHAINS if CHAINS[c][0][0] == "utf-8")}
    names = [CLEAN, *CHAINS]
    counts = np.full((len(names), BUCKETS), 0.02)
    for t, n in clean.items():
        for k, name in enumerate(names):
            made = t if k == 0 else garble(t, name)
            if made is not None and (k == 0 or made != t):
                for token in re.findall(TOKEN, made):
                    for _, part in stretches(token):
                        np.add.at(counts[k], features(part), n)
    return {"names": names, "logp": np.log(counts / counts.sum(axis=1, keepdims=True)).astype("float32")}


class Repairer:
    """Applies a trained model; remembers tokens it has judged."""

    #: Log odds before looking: most tokens are clean; valid UTF-8 inside a token is strong evidence of its own.
    PRIOR, SINGLE, STRICT, KEEP = -4.0, -8.0, 7.0, 100_000
    #: Log odds for a chain that turns a strange word into a usual one, and against one that does the opposite, or that makes
    #: a letter of a sign that stands alone; those say nothing for a chain.
    CASE = 6.0
    #: Log odds of one token that outweigh its neighbours: a sign that no right text has.
    PLAIN = 16.0

    def __init__(self, model: dict):
        self.model, self.seen = model, {}
        self.tokens, self.code, self.script, self.foreign = re.compile(TOKEN), re.compile(CODE), re.compile(f"[{SCRIPT}]"), re.compile(FOREIGN)
        self.multi = [k for k, name in enumerate(model["names"]) if k and CHAINS[name][0][0] == "utf-8"]
        self.single = [k for k, name in enumerate(model["names"]) if k and CHAINS[name][0][0] != "utf-8"]

    def judge(self, token: str) -> tuple:
        """((chain, restored token) or None of the UTF-8 chains, log odds of the single-byte chains)."""
        if token in self.seen:
            return self.seen[token]
        x = features(token)
        scores = self.model["logp"][:, x].sum(axis=1)
        # A long token repeats the same evidence; its weight is that of at most 40 bigrams.
        odds = (scores - scores[0]) * min(1.0, 40 / len(x))
        best = None
        for k in sorted(self.multi, key=lambda k: -odds[k]):
            if odds[k] + self.PRIOR + self.STRICT <= 0:
                break
            chain = self.model["names"][k]
            if (text := invert(token, chain)) is not None:
                best = chain, text
                break
        single = odds[self.single]
        if best is None and not token.isascii():
            before, alone = strange(token), len(token) == 1 and token in SIGNS
            for n, k in enumerate(self.single):
                if alone:
                    single[n] = min(single[n], 0) - self.CASE
                elif (before or single[n] > 0) and (text := invert(token, self.model["names"][k])) is not None and before != strange(text):
                    single[n] = single[n] + self.CASE if before else min(single[n], 0) - self.CASE
        out = best, single
        if len(self.seen) < self.KEEP:
            self.seen[token] = out
        return out

    def segment(self, text: str, chains: Counter) -> str:
        """One line or element, restored. A single-byte chain is judged over all tokens of a segment, as it leaves no
        sign of its own: one rightly written accent speaks against it. Tokens are read in stretches, each over all its bytes."""
        tokens = list(self.tokens.finditer(text))
        found = [(m.start() + at, part) for m in tokens for at, part in stretches(m[0])]
        if not found:
            return text
        judged = [self.judge(part) for _, part in found]
        rest = [j for j in judged if j[0] is None]
        single = None
        if rest:
            # Foreign signs come out of no chain: they may speak against one, never for it.
            foreign = ["".join(self.foreign.findall(m[0])) for m in tokens if self.script.search(m[0])]
            odds = sum(j[1] for j in rest) + sum(np.minimum(self.judge(x)[1], 0) for x in foreign) + self.SINGLE
            k = int(odds.argmax())
            if odds[k] <= 0:
                k = int(max(rest, key=lambda j: j[1].max())[1].argmax())
            if odds[k] > 0 or max(j[1][k] for j in rest) >= self.PLAIN:
                single = self.model["names"][self.single[k]]
        out, at = [], 0
        for (start, part), (multi, _) in zip(found, judged, strict=True):
            chain, new = multi or (single, invert(part, single) if single else None)
            if new is not None:
                chains[chain] += 1
                out += [text[at:start], new]
                at = start + len(part)
        return "".join(out) + text[at:]

    def repair(self, text: str | None) -> tuple[bool, str | None, str | None]:
        """(garbled, chain, restored text); the restored text is null where signs are lost for good."""
        if not text or (text.isascii() and "&" not in text):
            return False, None, None
        bare = html.unescape(text) if "&" in text else text
        samples: list[str] = []
        if "<" in bare or "`" in bare:
            keep = lambda m: samples.append(m[0]) or f"\x01{len(samples) - 1}\x01"
            bare = self.code.sub(keep, bare)
        if bare.isascii():
            return False, None, None
        chains: Counter = Counter()
        out = "".join(x if x.isascii() else self.segment(x, chains) for x in re.split(r"([<>\n]+)", bare))
        lost = "�" in bare
        if not chains and not lost:
            return False, None, None
        if samples:
            out = re.sub("\x01(\\d+)\x01", lambda m: samples[int(m[1])] if int(m[1]) < len(samples) else m[0], out)
        return True, chains.most_common(1)[0][0] if chains else "lost", None if lost else out


def fit(*tables: DataFrame) -> dict:
    """Train on at most TRAIN_ROWS lines or elements of each table, the same ones every time. ``tables``: one string column
    named text. Lines of over TRAIN_SIGNS signs are not drawn; none is cut.

    The sample is the lines of smallest hash; of a large table only every so-manieth row by hash is looked at, so that what
    reaches the driver does not grow with the table.
    """
    found = []
    for texts in tables:
        step = max(1, texts.count() // (20 * TRAIN_ROWS))
        texts = texts.filter((F.pmod(F.xxhash64("text"), F.lit(step)) == 0) & F.rlike("text", F.lit(r"[^\x00-\x7f]")))
        lines = texts.select(F.explode(F.split("text", r"[<>\n]+")).alias("text")).filter(F.rlike("text", F.lit(r"[^\x00-\x7f]")) & (F.length("text") <= TRAIN_SIGNS))
        least = lines.withColumn("h", F.xxhash64("text")).orderBy("h", "text").limit(TRAIN_ROWS)
        # Gathered by a task: on its own, a collected top-k sends every task's rows to the driver.
        found += sorted(least.agg(F.collect_list("text").alias("texts")).first().texts)
    return train(found)


def repair_udf(spark, model: dict):
    """(text) -> struct(garbled, chain, restored); the model (under 1 MB) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("garbled boolean, chain string, restored string")
    def repaired(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(shared.value)
        for batch in batches:
            yield pd.DataFrame([repairer.repair(x if isinstance(x, str) else None) for x in batch], columns=["garbled", "chain", "restored"]).astype({"chain": object, "restored": object})

    return repaired


def _suspects(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts of outcomes and pages with a sign beyond ASCII or an entity, repaired; and the model's training texts."""
    outcomes, pages = table(spark, sf_dir, "outcomes"), table(spark, sf_dir, "pages")
    model = fit(outcomes.select(F.col("raw_text").alias("text")), pages.select(F.col("cleaned_html").alias("text")))
    some = lambda c: F.rlike(c, F.lit(r"[^\x00-\x7f]|&[A-Za-z]+;|&#"))
    texts = (
        outcomes.filter(some("raw_text")).select(F.lit("outcomes").alias("tbl"), F.col("outcome_id").cast("long").alias("item_id"), F.col("raw_text").alias("text"))
        .unionByName(pages.filter(some("cleaned_html")).select(F.lit("pages").alias("tbl"), F.col("page_id").cast("long").alias("item_id"), F.col("cleaned_html").alias("text")))
    )
    return texts.withColumn("r", repair_udf(spark, model)("text")).filter("r.garbled")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """tbl, item_id of every garbled raw_text and cleaned_html. Null, empty and plain ASCII texts are no cases; code
    samples are left out before looking. An empty table trains a model without evidence and gives no rows."""
    return _suspects(spark, sf_dir).select("tbl", "item_id")


def p5_restored(spark, sf_dir: str) -> DataFrame:
    """tbl, item_id, chain (``lost``: signs are gone) and the text as it was written, null where that can't be told."""
    return _suspects(spark, sf_dir).select("tbl", "item_id", "r.chain", "r.restored")
