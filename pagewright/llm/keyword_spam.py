"""Pages of keywords, links and tags instead of sentences.

A text is cut into units (sentences, lines) and neighbouring units into blocks: those that end like sentences and those
that do not. A block is compressed twice: as it stands, with every link as one sign, and as its structure, in which a run
of words is its length and links, tags, signs and line ends are one sign each. Keywords and links repeat the words, the
structure, or both; prose repeats neither. Both ratios are taken against the usual ones of sentences of the same language
and length, a statistic over the blocks of all documents, and their product is the block's redundancy. Extreme redundancy
counts where sentence ends are missing, or, where keywords are dressed up as sentences, where one pair of words fills the
block. A document is spam if redundant blocks are its greater part. Sentences and lines that come again are compressed
once, so that a refrain does not count, and blocks full of the signs of code are none of keywords.

There are no lists of words or separators: what decides is compression and the density of sentence ends.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.tables import cut, spread, table

BLOCK = 1200
#: A block without sentence ends is extremely redundant below this share of the usual ratios, words times structure ...
REDUNDANT = 0.65
#: ... and one of sentences below this share of the usual ratio of words, if one pair of words makes up KEYWORD of it.
DRESSED = 0.6
KEYWORD = 0.2
#: Words, or links, that a block of keywords has at least; signs of code a word that make it one of code.
WORDS, LINKS, CODE_SIGNS = 12, 2, 0.2
#: Words in a row that the structure holds as their number; of longer runs it holds the length of every word.
RUN = 8
#: Blocks of a language and length from which their median counts; with fewer that of all languages does.
ENOUGH = 30
URL = r"(?:https?://|www\.)[^\s<>\"')\]]+"
LINK = rf"!?\[[^\]\n]*\]\([^)\s]*\)|<a\b[^>]*>.*?</a>|{URL}"
WORD = r"[^\W_]+(?:['’_-][^\W_]+)*"
BINS = 10


def packed(data: bytes) -> int:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return len(c.compress(data)) + len(c.flush())


class Looker:
    """Blocks of one text at a time and what they compress to."""

    def __init__(self):
        self.run, self.link = re.compile(rf"#[^\W_][\w-]*|{WORD}(?:[ \t]+{WORD})*|[^\S\n]+"), re.compile(LINK, re.S)
        self.unit = re.compile(r"[.!?…][\"')\]»”]*\s+|[。！？]|\n+")
        self.end, self.last_link = re.compile(r"[.!?…。！？][\"')\]»”]*$"), re.compile(rf"(?:{LINK})$", re.S)
        self.code = re.compile(r"[(){}=]|(?<!<)<(?!<)|(?<!>)>(?!>)|--|;\s*$", re.M)
        self.words, self.key = re.compile(r"[^\W_]+"), re.compile(r"[^\W\d_]{2,}(?:['’-][^\W_]+)*")

    def shape(self, m: re.Match) -> str:
        run = m[0]
        if run[0] == "#":
            return "#"
        words = run.split()
        return chr(48 + len(words)) if 0 < len(words) <= RUN else "".join([chr(97 + min(len(w), 20)) for w in words])

    def structure(self, bare: str) -> str:
        """A block, its links already one sign each, with a sign for every run of words and every tag, and without blanks."""
        return self.run.sub(self.shape, bare)

    def units(self, text: str) -> Iterator[str]:
        at = 0
        for m in self.unit.finditer(text):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]

    def parts(self, unit: str) -> Iterator[str]:
        """A unit in parts of at most BLOCK signs, cut at blanks where there are any."""
        while len(unit) > BLOCK:
            k = unit.rfind(" ", BLOCK // 2, BLOCK) + 1 or BLOCK
            yield unit[:k]
            unit = unit[k:]
        yield unit

    def blocks(self, text: str | None) -> list[tuple[str, bool, int]]:
        """(text, whether its units end like sentences, its length with all that comes again) of the blocks of a text."""
        out: list[list] = []
        now, ended, size, where = [], None, 0, {}
        for unit in self.units(text or ""):
            bare = unit.strip()
            if not bare:
                continue
            name = " ".join(bare.split())
            if name in where:
                out[where[name]][2] += len(bare)
                continue
            ends = bool(self.end.search(bare, max(0, len(bare) - 4))) and not (("://" in bare or "www." in bare or "](" in bare or "</a>" in bare) and self.last_link.search(bare))
            for part in self.parts(unit):
                if now and (ends != ended or size + len(part) > BLOCK + BLOCK // 4):
                    out[-1][0] = "".join(now)
                    now, size = [], 0
                if not now:
                    out.append(["", ends, 0])
                ended, size = ends, size + len(part)
                now.append(part)
                out[-1][2] += len(part.strip())
            where[name] = len(out) - 1
        if now:
            out[-1][0] = "".join(now)
        return [tuple(x) for x in out]

    def look(self, text: str | None) -> list[tuple]:
        """(signs, bin of length, sentences, ratio of words, ratio of structure, listed, share of the commonest pair) a block.
        ``listed``: there are words or links enough, and it is no code."""
        out = []
        for block, ended, size in self.blocks(text):
            block = block.strip()
            data = len(block.encode("utf-8", "replace"))
            bare = self.link.sub("\x01", block) if "://" in block or "www." in block or "](" in block or "</a>" in block else block
            form = self.structure(bare).encode("utf-8", "replace")
            ratio = packed(bare.encode("utf-8", "replace")) / max(1, data)
            listed, pair = False, 0.0
            if not ended:
                words, keys, links = len(self.words.findall(bare)), len(self.key.findall(bare)), bare.count("\x01")
                listed = (keys >= WORDS and 2 * keys >= words or links >= LINKS) and len(self.code.findall(bare)) < CODE_SIGNS * max(1, words + links)
            elif ratio < 0.5:  # one pair cannot fill a block that compresses as badly as this
                words = self.words.findall(bare.lower())
                pair = 2 * max(Counter(zip(words, words[1:])).values(), default=0) / max(1, len(words))
            out.append((size, min(BINS, len(block).bit_length() - 1), ended, ratio, packed(form) / max(1, len(form)), listed, pair))
        return out


BLOCKS = "array<struct<n:int,bin:int,ended:boolean,ratio:double,form:double,listed:boolean,pair:double>>"


def looked(documents: DataFrame) -> DataFrame:
    """doc_id, lang (its first two or three letters), blocks of every document, row by row."""
    kind = pa.list_(pa.struct([("n", pa.int32()), ("bin", pa.int32()), ("ended", pa.bool_()), ("ratio", pa.float64()), ("form", pa.float64()), ("listed", pa.bool_()), ("pair", pa.float64())]))
    names = [f.name for f in kind.value_type]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looker = Looker()
        for batch in batches:
            offsets, rows = [0], []
            for text in batch.column(2).to_pylist():
                rows += looker.look(text)
                offsets.append(len(rows))
            cols = list(zip(*rows)) or [()] * len(names)
            flat = pa.StructArray.from_arrays([pa.array(c, kind.value_type.field(n).type) for n, c in zip(names, cols, strict=True)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "lang", "blocks"])

    lang = F.regexp_extract(F.lower(F.coalesce("lang", F.lit(""))), "^[a-z]{2,3}", 0)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    return spread(texts).mapInArrow(each, f"doc_id long, lang string, blocks {BLOCKS}")


def usual_ratios(docs: DataFrame) -> dict:
    """(language, bin) -> median ratios of words and structure over the blocks of sentences of all documents; language ""
    holds for all. There are at most as many as codes of two or three letters times bins, so the driver may hold them."""
    blocks = docs.select("lang", F.inline("blocks")).filter("ended")
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    rows = blocks.rollup("bin", "lang").agg(F.count(F.lit(1)).alias("n"), median("ratio").alias("ratio"), median("form").alias("form"), F.grouping_id().alias("all")).filter("all < 2")
    return {("*" if r["all"] else r["lang"], r["bin"]): (r.ratio, r.form) for r in rows.collect() if r["all"] or r.n >= ENOUGH}


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, size and spam (signs of its blocks, and of the redundant ones) of every document, row by row. The blocks are
    written once; the second pass looks up the usual ratios, so nothing is joined back or shuffled."""
    docs = cut(looked(documents))
    shared = documents.sparkSession.sparkContext.broadcast(usual_ratios(docs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = shared.value
        for batch in batches:
            sizes, spams = [], []
            for lang, blocks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = spam = 0
                for b in blocks:
                    size += b["n"]
                    ratio, form = usual.get((lang, b["bin"])) or usual.get(("*", b["bin"])) or (1.0, 1.0)
                    share = b["ratio"] / ratio
                    if b["ended"]:
                        bad = share < DRESSED and b["pair"] >= KEYWORD or b["ratio"] < DRESSED / 2 and b["pair"] >= 1.4 * KEYWORD
                    else:
                        bad = b["listed"] and share * b["form"] / form < REDUNDANT
                    spam += b["n"] if bad else 0
                sizes.append(size)
                spams.append(spam)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spams, pa.int64())], names=["doc_id", "size", "spam"])

    return docs.mapInArrow(each, "doc_id long, size long, spam long")


def p10_found(spark, sf_dir: str) -> DataFrame:
    """doc_id of every document of which the greater part is extremely redundant blocks. Null, empty and blank texts are no
    cases; every row is judged by itself, and a repeated doc_id comes out once."""
    return scored(table(spark, sf_dir, "documents")).filter("2 * spam > size").select("doc_id").distinct()
