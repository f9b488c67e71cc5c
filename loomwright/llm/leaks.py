"""Problem 5: evaluation texts inside training texts, by size-partitioned MinHash containment search.

Jaccard similarity says nothing about a short item in a long document, so the items are
partitioned by their number of shingles and sketched for *containment*: an item keeps the
shingles whose hash is below a share of the hash space (a MinHash sketch of variable size), and
that share is chosen per size partition so that a sketch holds ``SKETCH`` hashes at most on
average.  A document is an asymmetric query: it looks up its own shingles, never a sketch of its
own size, so its length does not dilute anything.  A document that meets a sketch is a candidate
for the item, and only candidates are verified, on the words of document and item themselves.

Shingles that many items share (an instruction line) would pair every item with every document
that has the line.  They are left out of a sketch as long as all that is left out covers less
than the words asked for: a document that holds enough of the item must then hold another
shingle too.  Where a line alone is enough, its pairs are results.

Items up to ``SKETCH`` shingles keep all others and are found without fail.  Of longer ones
``recall`` gives the least chance: it holds where every run found is just ``width`` words long
and stands alone; runs of twice that length already leave less than one miss in 10,000.

Only documents with a hash that passes a Bloom filter of the sketches leave the scan, with their
hashes that do and their text, which the verification needs: about one document in a thousand
passes by chance.  The filter has 64 bits for each hash of the sketches, 32 MB at most; beyond
that more documents pass and the join does the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.words import WordHasher, shingle_hashes, words_of
from loomwright.session import cut_lineage
from loomwright.sources.tables import table

WIDTH, SHARE = 8, 0.5
#: Hashes of a sketch at most on average.
SKETCH = 64
#: Part of the words asked for that shingles left out of a sampled sketch may cover.
SAMPLED_SPARE = 0.125
#: Bits of the filter, as powers of two, and probes of a hash.
LEAST_BITS, MOST_BITS = 16, 28
PROBES = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]


def scale_of(shingles: int, sketch: int = SKETCH) -> float:
    """The size partition, 1, 1.5, 2, 3, 4, 6 and so on: sketches keep 1/scale of the hash space there."""
    scale = 1.0
    while shingles > sketch * scale:
        scale *= 1.5 if scale == 2 ** round(np.log2(scale)) else 4 / 3
    return scale


def recall(shingles: int, share: float = SHARE, width: int = WIDTH, sketch: int = SKETCH) -> float:
    """Least chance that a document with ``share`` of an item's words in runs of ``width`` meets its sketch."""
    scale, words = scale_of(shingles, sketch), (shingles + width - 1) * share
    if scale == 1:
        return 1.0
    return 1 - (1 - 1 / scale) ** (words * (1 - SAMPLED_SPARE) / width)


def read_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, cls, words``: the words of each item, joined by blanks; ``cls`` is equal for items of the same words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "words": [" ".join(words_of(t)) for t in b["text"]]})

    d = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"item {dict(items.dtypes)[key]}, words string").select("item", F.unhex(F.md5("words")).alias("cls"), "words")


def _shingles(classes: DataFrame, width: int) -> DataFrame:
    """``cls, n_words, pos, h``: one row per position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for b in batches:
            words = [t.split() for t in b["words"]]
            hashes = [shingle_hashes(hasher(w), width).astype(np.int64) for w in words]
            n = [len(h) for h in hashes]
            if sum(n):
                pos = np.concatenate([np.arange(k) for k in n])
                yield pd.DataFrame({"cls": np.repeat(b["cls"].to_numpy(), n), "n_words": np.repeat([len(w) for w in words], n), "pos": pos, "h": np.concatenate(hashes)})

    return classes.mapInPandas(run, "cls binary, n_words int, pos int, h long")


def choose(pos: np.ndarray, h: np.ndarray, n_items: np.ndarray, n_words: int, share: float, width: int, sketch: int) -> tuple[float, np.ndarray]:
    """(scale, hashes of the sketch) of one item; ``n_items``: in how many items a shingle stands."""
    scale = scale_of(len(h), sketch)
    spare = n_words * share * (1 if scale == 1 else SAMPLED_SPARE)
    covered, dropped = np.zeros(n_words, dtype=bool), set()
    order = np.lexsort((h, -n_items))
    for k in order:
        if n_items[k] < 2:
            break
        if h[k] in dropped:
            continue
        with_it = covered.copy()
        for p in pos[h == h[k]]:
            with_it[p : p + width] = True
        if with_it.sum() >= spare:
            break
        covered = with_it
        dropped.add(h[k])
    kept = np.array([x for x in np.unique(h) if x not in dropped], dtype=np.int64)  # never empty: all of them together cover the item
    low = kept.astype(np.uint64) <= np.uint64(((1 << 65) - 2) // int(2 * scale))
    return scale, kept[low] if low.any() else kept[np.argmin(kept.astype(np.uint64))][None]


def item_sketches(classes: DataFrame, share: float = SHARE, width: int = WIDTH, sketch: int = SKETCH) -> DataFrame:
    """``cls, scale, h``: the sketch of each class of items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [choose(*(np.array([x[k] for x in xs]) for k in ("pos", "h", "n_items")), n, share, width, sketch) for n, xs in zip(b["n_words"], b["xs"])]
            n = [len(kept) for _, kept in made]
            if sum(n):
                yield pd.DataFrame({"cls": np.repeat(b["cls"].to_numpy(), n), "scale": np.repeat([s for s, _ in made], n), "h": np.concatenate([kept for _, kept in made])})

    rows = _shingles(classes, width)
    often = rows.groupBy("h").agg(F.count_distinct("cls").alias("n_items"))
    whole = rows.join(often, "h").groupBy("cls", "n_words").agg(F.collect_list(F.struct("pos", "h", "n_items")).alias("xs"))
    return whole.mapInPandas(run, "cls binary, scale double, h long")


def _bit_of(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h.astype(np.uint64) * np.uint64(probe)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def passes(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes that the filter knows; each probe looks only at what the ones before it let pass."""
    for probe in PROBES:
        at = _bit_of(h, probe, len(held) * 8)
        h = h[((held[at >> 3] >> (at & 7)) & 1).astype(bool)]
    return h


def _bloom_filter(hashes: DataFrame) -> np.ndarray:
    """The filter of all hashes, or-ed in eight tasks: the driver gets eight of them, one at a time."""
    n = hashes.count()
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            for probe in PROBES:
                at = _bit_of(b["h"].to_numpy(), probe, bits)
                np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"m": [held.tobytes()]})

    total = np.zeros(bits // 8, dtype=np.uint8)
    for r in hashes.coalesce(8).mapInPandas(run, "m binary").toLocalIterator():
        total |= np.frombuffer(r["m"], dtype=np.uint8)
    return total


def documents_hit(docs: DataFrame, bloom: np.ndarray, width: int = WIDTH) -> DataFrame:
    """``doc, text, hs`` of the documents with shingles that may belong to a sketch, and the distinct hashes of these."""
    held = docs.sparkSession.sparkContext.broadcast(bloom.tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, bits = WordHasher(), np.frombuffer(held.value, dtype=np.uint8)
        for b in batches:
            found = [np.unique(passes(bits, shingle_hashes(hasher(words_of(t)), width).astype(np.int64))) for t in b["text"]]
            yield b[["doc", "text"]].assign(hs=found)[[len(h) > 0 for h in found]]

    return docs.select("doc", "text").mapInPandas(run, f"doc {dict(docs.dtypes)['doc']}, text string, hs array<long>")


def covered_words(doc_words: list[str], items: list[list[str]], width: int = WIDTH) -> list[int]:
    """How many words of each item lie in runs of ``width`` words that stand in the document too."""
    hasher = WordHasher()
    hashes = [shingle_hashes(hasher(w), width) for w in items]
    own = shingle_hashes(hasher(doc_words), width)
    at = np.nonzero(np.isin(own, np.concatenate(hashes)))[0] if hashes else []
    there = {tuple(doc_words[p : p + width]) for p in at}
    out = []
    for w in items:
        met = np.zeros(len(w), dtype=bool)
        for p in range(len(w) - width + 1):
            if tuple(w[p : p + width]) in there:
                met[p : p + width] = True
        out.append(int(met.sum()))
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", share: float = SHARE, width: int = WIDTH, sketch: int = SKETCH) -> DataFrame:
    """``doc, item, n_words, covered, coverage`` of each pair with ``share`` of the item's words covered.

    A word is covered when it lies in a run of ``width`` consecutive words that the document
    has too.  Null and empty texts, and items under ``width`` words, never match.  Rows of one
    document key are one result, that of the row with the most words covered; every item key of a
    repeated item text is reported.  Empty tables give an empty result.  The planner broadcasts
    sketches or candidates only below the session's threshold, else it shuffles.
    """
    d = docs.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(text).alias("text"))
    members = cut_lineage(read_items(items, item_key, text))
    classes = members.groupBy("cls").agg(F.first("words").alias("words"))
    sketches = cut_lineage(item_sketches(classes, share, width, sketch))
    hit = cut_lineage(documents_hit(d, _bloom_filter(sketches.select("h").distinct()), width).withColumn("row", F.monotonically_increasing_id()))
    candidates = hit.select("row", F.explode("hs").alias("h")).join(sketches.select("cls", "h"), "h").select("row", "cls").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, xs in zip(b["doc"], b["text"], b["xs"]):
                words = [x["words"].split() for x in xs]
                rows += [(k, x["cls"], len(w), n) for x, w, n in zip(xs, words, covered_words(words_of(t), words, width)) if n >= len(w) * share]
            yield pd.DataFrame(rows, columns=["doc", "cls", "n_words", "covered"]).astype({"doc": b["doc"].dtype})

    asked = candidates.join(classes, "cls").groupBy("row").agg(F.collect_list(F.struct("cls", "words")).alias("xs"))
    checked = hit.drop("hs").join(asked, "row").mapInPandas(verify, f"doc {dict(d.dtypes)['doc']}, cls binary, n_words int, covered int")
    return (
        checked.groupBy("doc", "cls", "n_words").agg(F.max("covered").alias("covered")).join(members.select("item", "cls").distinct(), "cls")
        .select("doc", "item", "n_words", "covered", (F.col("covered") / F.col("n_words")).alias("coverage"))
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, with the item."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p5_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item, with the number of documents that hold it and the largest coverage."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_docs"), F.round(F.max("coverage"), 6).alias("max_coverage"))


QUERIES = {"p5_found": p5_found, "p5_leaked_items": p5_leaked_items}
SQL: dict[str, str] = {}
