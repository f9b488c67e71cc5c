"""Problem 1: near-duplicate records, by covering locality-sensitive hashing.

A text is the set of its 5-character substrings; its signature is a vector of min-hashes, so
that two texts of similarity J differ in a position with probability 1 - J.  The signature is
cut into ``PARTS`` parts of ``POSITIONS`` positions.  In a part, every position gets a
non-zero vector of F2^(RADIUS+1), and every non-zero vector v of that space is a bit mask: the
positions whose vector has an odd inner product with v.  Any RADIUS differing positions span
less than the whole space, so some v is orthogonal to all of them and its mask avoids them:
two parts that differ in at most RADIUS positions agree on the whole of some mask and collide
in its table.  By the pigeonhole principle every pair of signatures within

    PARTS * (RADIUS + 1) - 1 = 41 of 126 positions

collides in some table, without exception.  A pair of similarity 0.6 differs in 50 positions on
average, so beyond the radius collisions are only likely: ``recall`` computes the chance that a
pair of a similarity meets in some table from the masks: 0.9967 at 0.6, 0.9997 at 0.65 and over
0.9999 at 0.7.

A row of a table is a bucket, a number and 64 bits of a sketch.  Colliding pairs are compared on
these bits inside the join, distinct ones on the whole sketch of 256 bits, and what is left, which
is close to the result, is verified on the substrings themselves.
Exact copies are collapsed before, so a text that holds a third of all rows is one row here.
A hot bucket is not gathered anywhere: the join sorts and streams it, and adaptive execution
splits its partition on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.components import components
from loomwright.session import cut_lineage
from loomwright.sources.tables import table

SHINGLE, SIMILARITY, LEAST_CHARS = 5, 0.6, 40
POSITIONS, RADIUS, PARTS = 9, 2, 14
SKETCH_BITS = 256
#: Differing sketch bits allowed: the mean at the threshold similarity and four deviations.
BLOCK = 1 << 15


def covering_masks(positions: int = POSITIONS, radius: int = RADIUS) -> list[list[int]]:
    """Masks over ``positions`` such that any ``radius`` positions are avoided by one of them."""
    space = 1 << (radius + 1)
    vectors = [1 + i % (space - 1) for i in range(positions)]
    return [[i for i, m in enumerate(vectors) if (m & v).bit_count() & 1] for v in range(1, space)]


def recall(similarity: float, positions: int = POSITIONS, radius: int = RADIUS, parts: int = PARTS) -> float:
    """Chance that a pair of this similarity shares a bucket of some table."""
    masks = [sum(1 << i for i in m) for m in covering_masks(positions, radius)]
    met = sum(
        similarity ** s.bit_count() * (1 - similarity) ** (positions - s.bit_count())
        for s in range(1 << positions) if any(m & s == m for m in masks)
    )
    return 1 - (1 - met) ** parts


def most_differing_bits(similarity: float, bits: int = SKETCH_BITS) -> int:
    p = (1 - similarity) / 2
    return int(bits * p + 4 * (bits * p * (1 - p)) ** 0.5)


def conversation_text(messages: str | Column) -> Column:
    """Contents of all messages but system ones, joined, lower-cased, letters and digits only."""
    m = F.col(messages) if isinstance(messages, str) else messages
    kept = F.filter(m, lambda x: ~F.coalesce(F.lower(F.trim(x["role"])) == "system", F.lit(False)))
    return F.regexp_replace(F.lower(F.array_join(F.transform(kept, lambda x: F.coalesce(x["content"], F.lit(""))), "")), r"[^\p{L}\p{N}]+", "")


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of all texts, and where each text starts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    h = np.zeros(max(0, len(codes) - SHINGLE + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    ends = np.cumsum(lengths)
    keep = np.ones(len(codes), dtype=bool)
    for k in range(1, SHINGLE):
        keep[ends - k] = False
    counts = lengths - SHINGLE + 1
    return h[keep[: len(h)]], np.concatenate([[0], np.cumsum(counts)[:-1]])


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


_A, _B = _odd(1, SKETCH_BITS), _odd(2, SKETCH_BITS)


def signatures(texts: list[str]) -> np.ndarray:
    """Min-hashes, one row per text; texts must have ``SHINGLE`` characters at least."""
    h, starts = _shingles(texts)
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(texts), SKETCH_BITS), dtype=np.uint32)
    bounds = np.append(starts, len(x))
    t = 0
    while t < len(texts):  # as many texts as fit the cache
        e = max(t + 1, int(np.searchsorted(bounds, bounds[t] + BLOCK)) - 1)
        part, at = x[bounds[t] : bounds[e]], starts[t:e] - bounds[t]
        for i in range(SKETCH_BITS):
            out[t:e, i] = np.minimum.reduceat(part * _A[i] + _B[i], at)
        t = e
    return out


def table_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket of each text in each table."""
    masks = covering_masks()
    keys = np.empty((len(sig), PARTS * len(masks)), dtype=np.uint64)
    wide = sig.astype(np.uint64)
    with np.errstate(over="ignore"):
        for p in range(PARTS):
            for m, mask in enumerate(masks):
                k = np.full(len(sig), p * len(masks) + m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for i in mask:
                    k = (k ^ wide[:, p * POSITIONS + i]) * np.uint64(0xBF58476D1CE4E5B9)
                    k ^= k >> np.uint64(31)
                keys[:, p * len(masks) + m] = k
    return keys.astype(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    bits = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            texts = part.column(1).to_pylist()
            sig = signatures(texts)
            keys, sk = table_keys(sig), sketches(sig)
            arrays = [part.column(0)]
            arrays += [pa.array(np.ascontiguousarray(sk[:, k])) for k in range(sk.shape[1])]
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *(f"s{k}" for k in range(sk.shape[1])), "keys"])


@F.pandas_udf(T.DoubleType())
def exact_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shared substrings over all; a text that comes again in a batch is cut up once."""
    sets: dict[str, np.ndarray] = {}

    def of(t: str) -> np.ndarray:
        if t not in sets:
            sets[t] = np.unique(_shingles([t])[0])
        return sets[t]

    out = np.empty(len(a))
    for i, (s, t) in enumerate(zip(a, b)):
        x, y = of(s), of(t)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = both / (len(x) + len(y) - both)
    return pd.Series(out)


def text_classes(df: DataFrame, key: str, text: Column, least: int = LEAST_CHARS) -> DataFrame:
    """``key, h, text``; ``h`` is the MD5 of the text, equal for exact copies."""
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), text.alias("text")).where(F.length("text") >= max(least, SHINGLE))
    return d.withColumn("h", F.unhex(F.md5("text")))


def near_duplicates(df: DataFrame, key: str, text: Column, similarity: float = SIMILARITY, least: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(links, members): links ``a, b, similarity`` between different texts, members ``key, h``.

    One text stands for all its exact copies, so links grow with the different texts only.
    Null keys, null texts and texts under ``least`` characters are left out; a repeated key
    with the same text counts once.  Empty tables give empty results.  Very long texts cost
    time in proportion to their length, in one task each.
    """
    classes = text_classes(df, key, text, least)
    members = classes.select("key", "h").distinct()
    reps = cut_lineage(classes.groupBy("h").agg(F.first("text").alias("text")).withColumn("id", F.monotonically_increasing_id()))
    words = [f"s{k}" for k in range(SKETCH_BITS // 64)]
    signed = cut_lineage(reps.select("id", "text").mapInArrow(_sign, "id long, " + ", ".join(f"{w} long" for w in words) + ", keys array<bigint>"))  # both sides of the join read it

    def differing(names: list[str]) -> Column:
        return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_"))) for w in names[1:]), F.bit_count(F.col(names[0]).bitwiseXOR(F.col(f"{names[0]}_"))))

    def other(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_" for c in df.columns})

    rows = signed.select("id", "s0", F.explode("keys").alias("bucket"))
    met = (F.col("bucket") == F.col("bucket_")) & (F.col("id") < F.col("id_")) & (differing(words[:1]) <= most_differing_bits(similarity, 64))
    pairs = rows.join(other(rows), met).select("id", "id_").distinct()
    sketch = signed.select("id", *words)
    close = pairs.join(sketch, "id").join(other(sketch), "id_").where(differing(words) <= most_differing_bits(similarity)).select("id", "id_")
    links = (
        close.join(reps, "id").join(other(reps), "id_")
        .select(F.col("h").alias("a"), F.col("h_").alias("b"), exact_similarity("text", "text_").alias("similarity")).where(F.col("similarity") >= similarity)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    )
    return links, members


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different ids whose texts have similarity 0.6 or more.

    The result is stated as pairs of ids, so copies are expanded here, behind the operator.
    """
    links, members = near_duplicates(table(spark, folder, "reformat_datasets"), "id", conversation_text("messages"))
    a, b = members.select(F.col("key").alias("x"), F.col("h").alias("a")), members.select(F.col("key").alias("y"), F.col("h").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b")
    same = a.join(b, F.col("a") == F.col("b"))
    both = across.select("x", "y").unionByName(same.where(F.col("x") < F.col("y")).select("x", "y")).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """``id, group_id, n_links``: the group of each conversation, and its links to different texts."""
    links, members = near_duplicates(table(spark, folder, "reformat_datasets"), "id", conversation_text("messages"))
    links = cut_lineage(links.select("a", "b"))
    ends = links.select(F.col("a").alias("h")).unionByName(links.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("n_links"))
    comp = components(links, "a", "b").withColumnRenamed("node", "h")
    return (
        members.join(ends, "h", "left").join(comp, "h", "left")
        .select(F.col("key").alias("id"), F.lower(F.hex(F.coalesce("component", "h"))).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL: dict[str, str] = {}
