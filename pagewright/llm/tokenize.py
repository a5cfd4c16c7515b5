"""Token ids of a whole corpus by a public byte-level vocabulary.

The merges are compiled into a deterministic automaton over token labels. It starts with one arc per byte; every merge
(a, b), in order, adds its gadget: after a, the arc b is taken out, and the arc ab leads to where a and then b led. So the
arc v after u is there exactly if it survives all gadgets, and the arcs of a token made later are those of the parts it
was made of, as they stood at that time. Written out, the arcs of 50,000 labels are billions, so the automaton keeps the
gadgets (parts, order, cut arcs) as flat tables and writes down the arcs that texts use, when they are first used.

A word's encoding is its one path through the automaton, found left to right from the tokens that end at each byte.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.tables import spread, table

#: Where the vocabulary files lie; a parameter of every function that reads them.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how the vocabulary's makers split text into words before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next free from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def compile_merges(path: str) -> dict:
    """The gadgets of a vocabulary file: token bytes, parts and order by id, and the cut arcs. About 5 MB at 50,000 ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    special = {k for k in vocab if not all(c in letters for c in k)}
    label = {i: bytes(letters[c] for c in k) for k, i in vocab.items() if k not in special}
    left, right, order, cut = {}, {}, {}, {}
    for n, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        x, y, ab = vocab[a], vocab[b], vocab[a + b]
        cut[x, y] = n
        if ab not in order:
            left[ab], right[ab], order[ab] = x, y, n
    # Labels that no merge makes (such as the end-of-text sign) have no arcs, nor have those whose gadget found none to
    # add: where b no longer followed a when the merge's turn came, no text has that token.
    alive = {i for i, b in label.items() if len(b) == 1}
    for ab, n in sorted(order.items(), key=lambda x: x[1]):
        if left[ab] in alive and right[ab] in alive and survives(left[ab], right[ab], n, left, right, order, cut):
            alive.add(ab)
    label = {i: b for i, b in label.items() if i in alive}
    return {"label": label, "left": left, "right": right, "order": order, "cut": cut} | spelling_tables(label)


def survives(a: int, b: int, when: int, left: dict, right: dict, order: dict, cut: dict) -> bool:
    """Whether the arc b after the token a is there when the gadgets before the ``when``-th are in."""
    while True:
        at = cut.get((a, b))
        if at is not None and at < when:
            return False
        x, y = order.get(a, -1), order.get(b, -1)
        if x < 0 and y < 0:
            return True
        # The later of the two took over the arcs of its part as they stood when it was made; a token ab is reached only
        # where the arc a stays, its own gadget's cut included (which matters if a is b).
        if y > x:
            when, b = min(when, y + 1), left[b]
        else:
            when, a = min(when, x), right[a]


def spelling_tables(label: dict[int, bytes]) -> dict:
    """Transitions over bytes that spell the labels: step[state * 256 + byte] is the next state, ends[state] the label."""
    step: dict[int, int] = {}
    ends = {}
    for i, data in label.items():
        state = 0
        for b in data:
            state = step.setdefault(state << 8 | b, len(step) + 1)
        ends[state] = i
    return {"step": step, "ends": ends}


class Automaton:
    """Reads words; arcs and words that were met are kept."""

    KEEP = 400_000

    def __init__(self, gadgets: dict):
        import re
        import unicodedata

        import regex

        self.label, self.left, self.right, self.order, self.cut = (gadgets[k] for k in ("label", "left", "right", "order", "cut"))
        self.step, self.ends = gadgets["step"], gadgets["ends"]
        self.token = {b: i for i, b in self.label.items()}
        self.longest = max(map(len, self.token), default=1)
        # The standard library's expressions are faster, and split alike where no sign is in the few classes that they
        # read otherwise: separators U+001C to U+001F, numbers that are no digits, and all beyond the first plane.
        odd = "".join(c for c in map(chr, range(128, 0x10000)) if unicodedata.category(c) in ("No", "Nl") or (c.isspace() and c in "\x1c\x1d\x1e\x1f"))
        self.odd = re.compile("[\x1c-\x1f\U00010000-\U0010ffff" + odd + "]").search
        self.split = re.compile(WORDS.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")).findall
        self.split_odd = regex.compile(WORDS).findall
        self.arcs: dict = {}
        self.words: dict = {}
        self.pieces: dict = {}
        self.blanks = re.compile(r" \s|\s | \Z|[\x1c-\x1f]").search

    def arc(self, u: int, v: int) -> bool:
        """Whether the automaton has the arc v after the token u, once all gadgets are in."""
        key = u << 20 | v
        found = self.arcs.get(key)
        if found is None:
            found = survives(u, v, 1 << 40, self.left, self.right, self.order, self.cut)
            if len(self.arcs) >= 4 * self.KEEP:
                self.arcs.clear()
            self.arcs[key] = found
        return found

    def word(self, text: str) -> list[int]:
        """Ids of one pre-split word. There is one path through the automaton, so the first that is whole is it."""
        data = text.encode("utf-8")
        whole = self.token.get(data)
        if whole is not None:
            return [whole]
        if len(data) > 64:
            return self.long_word(data)
        n, arc, step, ends = len(data), self.arc, self.step, self.ends
        spelled: list = [None] * n  # the labels that begin at a place, shortest first, with their ends
        out, places, dead = [], [0], set()
        i, end = 0, n
        while i < n:
            found = spelled[i]
            if found is None:
                found, state, j = [], 0, i
                while j < n and (state := step.get(state << 8 | data[j])):
                    j += 1
                    if state in ends:
                        found.append((j, ends[state]))
                spelled[i] = found
            last = out[-1] if out else -1
            for j, t in reversed(found):
                if j <= end and (j, t) not in dead and (last < 0 or arc(last, t)):
                    out.append(t)
                    places.append(j)
                    i, end = j, n
                    break
            else:  # no arc leads on from here: go back one token and try a shorter one
                dead.add((i, out.pop()))
                end = places.pop() - 1
                i = places[-1]
        return out

    def long_word(self, data: bytes) -> list[int]:
        """The same for long words in linear time: last[i] is the last token on the path of the first i bytes."""
        n, token, arc = len(data), self.token, self.arc
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = token.get(data[j:i])
                if t is not None and (j == 0 or arc(last[j], t)):
                    last[i], start[i] = t, j
                    break
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def piece(self, text: str) -> list[int]:
        """Ids of a stretch of text, word by word."""
        words, out = self.words, []
        for w in self.split_odd(text) if self.odd(text) else self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.word(w)
                if len(words) >= self.KEEP:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty one has none. Words never reach over a blank that stands between two other
        signs, so a text is cut there first and its pieces looked up; blanks in a row are left to the words' rule."""
        if not text:
            return []
        if self.blanks(text):
            return self.piece(text)
        first, *rest = text.split(" ")
        out, pieces = self.piece(first) if first else [], self.pieces
        for p in rest:
            ids = pieces.get(p)
            if ids is None:
                ids = self.piece(" " + p)
                if len(pieces) >= self.KEEP:
                    pieces.clear()
                if len(p) <= 64:
                    pieces[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


def encode_texts(spark, texts: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, ids of every row. The gadgets are compiled on the driver and broadcast: their size is the vocabulary's."""
    shared = spark.sparkContext.broadcast(compile_merges(path))
    kind = texts.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        automaton = Automaton(shared.value)
        for batch in batches:
            offsets, flat = [0], []
            for x in batch.column(1).to_pylist():
                flat += automaton.encode(x)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype="int32")), pa.array(np.array(flat, dtype="int32")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return spread(texts.select(key, text)).mapInArrow(encode, f"`{key}` {kind.simpleString()}, ids array<int>")


def p8_ids(spark, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids of every document. Null and empty texts have an empty list; repeated rows stay repeated."""
    return encode_texts(spark, table(spark, sf_dir, "documents"), "doc_id", "text", f"{tokenizers}/{VOCABULARY}")
