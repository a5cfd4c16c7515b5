"""Splitting oversized texts at natural boundaries, with overlap.

Content-defined chunking: a rolling hash over the signs makes landmarks that depend on the text alone. Each cut goes to
the strongest landmark between the smallest and the largest size and from there to the nearest natural boundary, so an
edit moves only the cuts near it. Cuts never fall inside a sign made of several characters, nor inside a tag, comment or
entity that is short enough to stand in one piece (7,800 signs).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.tables import spread, table

LIMIT, OVERLAP = 8000, 200
#: The least new text of a piece, if there is more; and how far a cut may go from its landmark for each kind of boundary.
LEAST = 4000
REACH = (2000, 1200, 800, 400, 200)
WINDOW = 32
#: Boundaries from best to worst: end of an element that stands alone, line end, end of a sentence, blank, edge of a tag.
BOUNDARIES = (
    r"</(?:p|div|h[1-6]|ul|ol|table|section|article|pre|blockquote|main|header|footer|figure|dl)\s*>\s*|\n[ \t\r]*\n\s*",
    r"</(?:li|tr|dd|dt|option)\s*>\s*|<(?:br|hr)\b[^>]*>\s*|\r?\n",
    r"[.!?…][\"')\]»”]*(?=\s)\s|[。！？](?=.)",
    r"\s+",
    r">(?=[^<])|(?=<[a-zA-Z/])",
)


def landmarks(text: str) -> np.ndarray:
    """Rolling hash of the WINDOW signs before each place; the smaller the value, the stronger the landmark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    h = np.zeros(n + 1, dtype=np.uint64)
    base = np.uint64(0x100000001B3)
    for i in range(WINDOW):
        part = np.zeros(n + 1, dtype=np.uint64)
        if n >= WINDOW:
            part[WINDOW:] = codes[i : n - WINDOW + 1 + i]
        h = h * base + part
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[: min(WINDOW, n + 1)] = np.iinfo(np.uint64).max
    return h


class Whole:
    """The places of a text where no cut may fall: within a tag, a comment, an entity, or signs that make one visible sign.

    Tags, comments and entities are found once, in one pass. Those longer than ``limit`` can stand in no piece and are left out."""

    SPANS = re.compile(r"<!--.*?-->|</?[A-Za-z!][^<>]*>|&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]\w{1,31});", re.S)

    def __init__(self, text: str, limit: int):
        self.text = text
        spans = [m.span() for m in self.SPANS.finditer(text) if m.end() - m.start() <= limit]
        self.starts, self.ends = ([x[k] for x in spans] for k in (0, 1))

    def joined(self, i: int) -> bool:
        """Whether place i lies inside something whole."""
        text = self.text
        if i <= 0 or i >= len(text):
            return False
        a, b = text[i - 1], text[i]
        if a == "\r" and b == "\n" or b in "‍️︎⃣" or a == "‍" or "\U0001f3fb" <= b <= "\U0001f3ff" or unicodedata.category(b) in ("Mn", "Me", "Mc"):
            return True
        if "\U0001f1e6" <= a <= "\U0001f1ff" and "\U0001f1e6" <= b <= "\U0001f1ff":
            k = i
            while k and "\U0001f1e6" <= text[k - 1] <= "\U0001f1ff":
                k -= 1
            if (i - k) % 2:
                return True
        k = bisect_left(self.starts, i) - 1
        return k >= 0 and i < self.ends[k]


def joined(text: str, i: int, limit: int = LIMIT - OVERLAP) -> bool:
    return Whole(text, limit).joined(i)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[int]:
    """Places where the pieces' new text ends; the last is the text's end. A piece with its overlap has at most limit signs."""
    n = len(text)
    if n <= limit:
        return [n]
    marks, joined = landmarks(text), Whole(text, limit - overlap).joined
    bounds = [np.array([m.end() for m in re.finditer(p, text)], dtype=np.int64) for p in BOUNDARIES]
    out, at = [], 0
    while True:
        room = limit - (overlap if at else 0)
        if n - at <= room:
            out.append(n)
            return out
        lo, hi = at + min(least, room), at + room
        mark = lo + int(marks[lo : hi + 1].argmin())
        place = None
        for last in (False, True):
            for b, reach in zip(bounds, REACH, strict=True):
                x, y = (lo, hi) if last else (max(lo, mark - reach), min(hi, mark + reach))
                i, j = np.searchsorted(b, x), np.searchsorted(b, y, "right")
                near = sorted(b[i:j].tolist(), key=lambda p: (abs(p - mark), p))
                place = next((p for p in near if not joined(p)), None)
                if place is not None:
                    break
            if place is not None:
                break
        if place is None:  # no boundary between the sizes, then one before the least size, then any place that breaks no sign
            for b in bounds:
                i, j = np.searchsorted(b, at + overlap + 1), np.searchsorted(b, lo)
                place = next((p for p in b[i:j][::-1].tolist() if not joined(p)), None)
                if place is not None:
                    break
        if place is None:
            place = next((p for p in range(mark, lo, -1) if not joined(p)), None) or next((p for p in range(mark, hi + 1) if not joined(p)), mark)
        out.append(place)
        at = place


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, str]]:
    """(start, text) of the pieces in order; each but the first begins with the last ``overlap`` signs of the one before."""
    out, at = [], 0
    for end in cuts(text, limit, overlap, least):
        start = max(0, at - overlap) if at else 0
        out.append((start, text[start:end]))
        at = end
    return out


def split_pages(pages: DataFrame) -> DataFrame:
    """page_id, piece (0, 1, ...), pieces, start, text of every page over the limit. Each page is cut where it lies: no
    shuffle, and a piece is written as soon as its batch is done."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, text in zip(batch["page_id"], batch["cleaned_html"], strict=True):
                found = pieces(text)
                rows += [(page, k, len(found), start, piece) for k, (start, piece) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["page_id", "piece", "pieces", "start", "text"])

    large = spread(pages.filter(F.length("cleaned_html") > LIMIT).select("page_id", "cleaned_html"))
    return large.mapInPandas(each, "page_id long, piece int, pieces int, start int, text string")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """page_id of every page that had to be cut. Null, empty and smaller pages are no cases."""
    return split_pages(table(spark, sf_dir, "pages")).filter("piece = 1").select("page_id")


def p6_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces of every page over the limit."""
    return split_pages(table(spark, sf_dir, "pages"))
