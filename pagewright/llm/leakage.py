"""Evaluation passages inside a training corpus, by greedy string tiling.

Seeds are runs of SEED words, hashed by Karp and Rabin's rolling polynomial; of every WINDOW neighbouring ones the one of
smallest hash is kept, so a text and an item that share LEAST words in a row share a kept seed. Documents and items meet on
their seeds. A pair that meets is tiled: the longest run of words that both have and that is not marked yet is marked, again
and again, and what share of the item lies in tiles is its coverage, so that passages in another order are caught.

The longest run is found by bisection over its length: the Karp-Rabin hashes of all unmarked runs of one length come from
the rolling sums of the text, so a round is linear in document and item; hashes that meet are held against the words. An
item has at most as many rounds as tiles fit into it, whatever the texts repeat.

Two plans give the same rows. Up to BLOCK words of items are broadcast, and the corpus is read once, without a shuffle.
More items meet the corpus in a join on seeds, after a filter of fixed size that lets few documents' seeds through; the
corpus is read once for its seeds and once for the texts that met an item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.tables import cut, spread, table

LEAST = 12
#: A kept seed has SEED words and is the least of WINDOW neighbours: SEED + WINDOW - 1 = LEAST.
SEED, WINDOW = 8, 5
#: Words of test items that are broadcast, 50 MB of Python objects at most; with more, items and documents are joined.
BLOCK = 1_000_000
#: Bits of the filter over the items' seeds in the join, 16 MB; more seeds let more through, no true one is stopped.
FILTER_BITS = 1 << 27
#: Parts into which an item that many documents hold is dealt out, so that no task gets all of them.
SALTS = 16
#: Share of an item that a document must hold to be named by ``p9_covered``.
COVERED = 0.5
BASE = 0x9E3779B97F4A7C15
WORD = r"[^\W_]+"


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` words, modulo 2**64, from their rolling sums: H[i+w] - H[i] * B**w."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if width <= 16:
        out, base = hashes[:n].copy(), np.uint64(BASE)
        for i in range(1, width):
            out = out * base + hashes[i : i + n]
        return out
    sums = [0]
    for x in hashes.tolist():
        sums.append((sums[-1] * BASE + x) & 0xFFFFFFFFFFFFFFFF)
    sums = np.array(sums, dtype=np.uint64)
    return sums[width:] - sums[:n] * np.uint64(pow(BASE, width, 1 << 64))


class Rolling:
    """A sequence of words as numbers, with its rolling sums and its marks."""

    def __init__(self, words: np.ndarray):
        self.words, sums, powers = words, [0], [1]
        for x in words.tolist():
            sums.append((sums[-1] * BASE + x * 0x2545F4914F6CDD1D + 1) & 0xFFFFFFFFFFFFFFFF)
            powers.append((powers[-1] * BASE) & 0xFFFFFFFFFFFFFFFF)
        self.sums, self.powers = np.array(sums, dtype=np.uint64), np.array(powers, dtype=np.uint64)
        self.marks = np.zeros(len(words) + 1, dtype=np.int64)  # marks before each place

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the unmarked runs of a width, and their hashes."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        free = np.flatnonzero(self.marks[width:] == self.marks[:n])
        return free, self.sums[free + width] - self.sums[free] * self.powers[width]

    def mark(self, place: int, width: int) -> None:
        self.marks[place + 1 : place + width + 1] += np.arange(1, width + 1)
        self.marks[place + width + 1 :] += width


def common(a: Rolling, b: Rolling, width: int) -> tuple[int, int] | None:
    """First place in ``a``, and in ``b``, of an unmarked run of a width that both have, held against the words."""
    at_a, hash_a = a.runs(width)
    at_b, hash_b = b.runs(width)
    if not len(at_a) or not len(at_b):
        return None
    hash_b, first = np.unique(hash_b, return_index=True)
    k = np.searchsorted(hash_b, hash_a)
    k[k == len(hash_b)] = 0
    for i in np.flatnonzero(hash_b[k] == hash_a).tolist():
        x, y = int(at_a[i]), int(at_b[first[k[i]]])
        if np.array_equal(a.words[x : x + width], b.words[y : y + width]):
            return x, y
    return None


def tiles(a: list[str], b: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in a, place in b, length) of the longest unmarked common runs, longest first; of equal
    ones the first in a. Words of one text that the other lacks split it before anything is hashed."""
    number: dict[str, int] = {}
    y = Rolling(np.array([number.setdefault(w, len(number)) for w in b], dtype=np.int64))
    lacking = len(number)
    x = Rolling(np.array([number.get(w, lacking) for w in a], dtype=np.int64))
    out, most = [], min(len(a), len(b))
    while most >= least:
        best, low, high = None, least, most
        # A longer common run holds every shorter one, so the length of the longest can be bisected.
        while low <= high:
            width = (low + high + 1) // 2 if best else low
            found = common(x, y, width)
            if found is None:
                high = width - 1
            else:
                best, low = (*found, width), width + 1
        if best is None:
            break
        out.append(best)
        x.mark(best[0], best[2])
        y.mark(best[1], best[2])
        most = best[2]
    return out


class Words:
    """Words of texts and their hashes; remembers the hashes of words."""

    KEEP = 500_000

    def __init__(self):
        self.find = re.compile(WORD).findall
        self.known: dict[str, int] = {}

    def read(self, text: str | None) -> tuple[list[str], np.ndarray]:
        words, known = self.find((text or "").lower()), self.known
        if len(known) > self.KEEP:
            known.clear()
        for w in set(words).difference(known):
            known[w] = word_hash(w)
        return words, np.array([known[w] for w in words], dtype=np.uint64)


def kept_seeds(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of the seeds that are the least of some WINDOW neighbours."""
    h = rolled(hashes, SEED)
    if len(h) < WINDOW:
        return np.empty(0, dtype=np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1))


def seed_table(items: list[tuple[int | None, str]]) -> dict:
    """Sorted seed hashes, the place of the item of each, and the items' ids and words by place: an id may come with several texts."""
    words, hashes, owner, reader = [], [], [], Words()
    for i, (_, t) in enumerate(items):
        w, h = reader.read(t)
        h = np.unique(rolled(h, LEAST))
        words.append(w)
        hashes.append(h)
        owner += [i] * len(h)
    h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    order = np.argsort(h, kind="stable")
    return {"hash": h[order], "item": np.array(owner, dtype=np.int64)[order], "ids": [i for i, _ in items], "words": words}


class Searcher(Words):
    """Rolls over documents against the seeds of all items."""

    def __init__(self, seeds: dict):
        super().__init__()
        self.hash, self.item, self.ids, self.words = seeds["hash"], seeds["item"], seeds["ids"], seeds["words"]

    def look(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item, words in tiles, words of the item) of the items that share a run with the text."""
        if not text or not len(self.hash):
            return []
        words, h = self.read(text)
        h = rolled(h, LEAST)
        if not len(h):
            return []
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        hits = np.unique(h[self.hash[at] == h])
        if not len(hits):
            return []
        lo, hi = np.searchsorted(self.hash, hits, "left"), np.searchsorted(self.hash, hits, "right")
        out = []
        for item in sorted({int(i) for a, b in zip(lo, hi, strict=True) for i in self.item[a:b]}):
            if found := tiles(words, self.words[item]):
                out.append((self.ids[item], sum(t[2] for t in found), len(self.words[item])))
        return out


FOUND = "doc_id long, item_id long, words int, coverage double"


def leaks(spark, documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, words (in tiles) and coverage (their share of the item) of every document and item that share at
    least LEAST consecutive words. Every text of an item_id that comes more than once is searched for, the fullest counts; a
    null item_id is one as well. Documents that repeat give their rows once. Null and short texts share nothing."""
    items = items.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A word has a sign at least and a blank beside it.
    words = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    found = _searched(spark, documents, items) if words <= block else _joined(spark, documents, items)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("coverage").alias("coverage"))


def _rows(rows: list) -> pa.RecordBatch:
    """Rows of FOUND. Arrow keeps ids whole where some are null."""
    kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "words": pa.int32(), "coverage": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def _searched(spark, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Items in a broadcast: they hold BLOCK words at most."""
    shared = spark.sparkContext.broadcast(seed_table([(r.item_id, r.text) for r in items.collect()]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value)
        for batch in batches:
            yield _rows([(d, i, n, n / size) for d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, n, size in searcher.look(text)])

    return spread(documents).mapInArrow(each, FOUND)


def _seeds(texts: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """key, seed of every kept seed of every text (key, text); ``bits``: a broadcast filter of the seeds worth having."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Words()
        mask = None if bits is None else bits.value
        for batch in batches:
            keys, seeds = [], []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                h = kept_seeds(reader.read(text)[1])
                if mask is not None and len(h):
                    at = h % np.uint64(FILTER_BITS)
                    h = h[(mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
                keys += [key] * len(h)
                seeds.append(h)
            yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "seed": (np.concatenate(seeds) if seeds else np.empty(0, dtype=np.uint64)).view(np.int64)})

    return spread(texts).mapInPandas(each, "key long, seed long")


def _filter(spark, seeds: DataFrame):
    """A broadcast bit field of FILTER_BITS bits with one set for every seed; the driver gets the distinct places in chunks of bits."""
    place = F.pmod("seed", F.lit(FILTER_BITS))  # a power of two: the low bits, whatever the sign
    chunks = seeds.select(place.alias("p")).groupBy((F.col("p") / 32768).cast("long").alias("chunk")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    field = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in chunks.toLocalIterator():  # 4,096 chunks of 4 kB at most
        field[r.chunk * 4096 : r.chunk * 4096 + 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return spark.sparkContext.broadcast(field)


def _joined(spark, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Items of any number: documents and items meet in a shuffle on their kept seeds, then the pairs get their texts.

    Rows are told apart by a hash of id and text, so that of equal rows one is tiled. The texts of an item that very many
    documents hold are dealt out SALTS times; documents are read again only where they met an item."""
    own = lambda d, i: d.filter("text IS NOT NULL").select(F.col(i), "text", F.xxhash64(i, "text").alias("key"))
    items, documents = own(items, "item_id"), own(documents, "doc_id")
    item_seeds = cut(_seeds(items.select("key", "text")))
    doc_seeds = _seeds(documents.select("key", "text"), _filter(spark, item_seeds))
    # A seed that stands in very many documents is dealt out too: each of its rows goes to one part, items to every part.
    part = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    wide = item_seeds.select(F.col("key").alias("item_key"), "seed").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = doc_seeds.distinct().withColumn("part", part).join(wide, ["seed", "part"]).select(F.col("key").alias("doc_key"), "item_key").distinct()
    pairs = cut(pairs)
    texts = pairs.join(documents.select(F.col("key").alias("doc_key"), "doc_id", "text").dropDuplicates(["doc_key"]), "doc_key").withColumn("part", F.pmod("doc_key", F.lit(SALTS)).cast("int"))
    known = items.select(F.col("key").alias("item_key"), "item_id", F.col("text").alias("item")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        for batch in batches:
            rows = []
            for d, i, text, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = find(item.lower())
                if n := sum(t[2] for t in tiles(find(text.lower()), words)):
                    rows.append((d, i, n, n / len(words)))
            yield _rows(rows)

    return texts.join(known, ["item_key", "part"]).select("doc_id", "item_id", "text", "item").mapInArrow(each, FOUND)


def p9_found(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id of every document that has a tile of LEAST words or more with an item."""
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p9_covered(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, words and coverage of the documents that hold at least the share COVERED of an item in tiles, in
    whatever order its passages stand there."""
    found = leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).filter(F.col("coverage") >= COVERED)
    return found.select("doc_id", "item_id", "words", F.round("coverage", 4).alias("coverage"))


def p9_report(spark, sf_dir: str) -> DataFrame:
    """item_id, documents that leak it, and the largest share of it that one of them holds."""
    found = leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max("coverage"), 4).alias("coverage"))


#: DuckDB SQL with the same rows.
SQL = r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents), b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
 dg as (select doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)), bg as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from b))
 select distinct doc_id, item_id from dg join bg using (g)"""
