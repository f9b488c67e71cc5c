"""Evaluation items in training rows: phrases, n-gram coverage, vectors; reports and removal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.grams import WordHashes, bloom_filter, gram_hashes, passing
from loomwright.functions.text import col, once, word_ngrams
from loomwright.session import cut_lineage

#: Fixed value: characters that part words.
SEPARATORS = r"[ ,.?!:;()\"\-\n\\]+"
_SEPARATORS = re.compile(SEPARATORS)


def tokens(c: str | Column) -> Column:
    """Lower-cased words between separators; the same rule for both sides."""
    return F.filter(F.split(F.lower(col(c)), SEPARATORS), lambda x: x != "")


def _words(text: str) -> list[str]:
    return [w for w in _SEPARATORS.split(text) if w]


def _grams_of(df: DataFrame, key: str, text: str, held: Broadcast, grams: tuple[int, ...], spelled: bool) -> DataFrame:
    """``_key, _gram`` (and ``_words``): n-grams of a row, for every n of ``grams``, that the filter lets pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = WordHashes(), np.frombuffer(held.value, dtype=np.uint8)
        for b in batches:
            keys, found, spelt = [], [], []
            for k, t in zip(b["_key"], b["_text"]):
                w = _words(t)
                h = known.of(w)
                for n in grams:
                    g = gram_hashes(h, n)
                    at = passing(bits, g)
                    once = dict(zip(g[at].tolist(), at.tolist()))
                    keys += [k] * len(once)
                    found += once
                    if spelled:
                        spelt += [" ".join(w[p : p + n]) for p in once.values()]
            out = pd.DataFrame({"_key": pd.Series(keys, dtype=b["_key"].dtype), "_gram": pd.Series(found, dtype="int64")})
            yield out.assign(_words=pd.Series(spelt, dtype=object)) if spelled else out

    d = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.lower(text).alias("_text"))
    return d.mapInPandas(run, f"_key {dict(df.dtypes)[key]}, _gram long" + (", _words string" if spelled else ""))


@F.pandas_udf(T.LongType())
def _gram_hash(text: pd.Series) -> pd.Series:
    known = WordHashes()
    return pd.Series([int(gram_hashes(known.of(w), len(w))[0]) if (w := t.split(" ")) else 0 for t in text], dtype="int64")


def _map_of(grams: DataFrame) -> tuple[Broadcast, DataFrame]:
    held = cut_lineage(grams)
    return held.sparkSession.sparkContext.broadcast(bloom_filter(held.select("_gram").distinct(), "_gram").tobytes()), held


def phrase_matches(train: DataFrame, items: DataFrame, train_key: str, item_key: str, text: str = "text", seed: int = 8, fields: list[str] | None = None) -> DataFrame:
    """``train_key, item_key``: rows that hold all words of an item in a row.

    ``fields`` names several columns of an item, each a phrase; all that are not empty must then
    stand in the same row.  The scan of the rows lets only those runs of words pass whose hash a
    Bloom filter of the items' first runs of ``seed`` words (all of a shorter phrase) knows; what
    passes is joined to the items, and the token strings of the pairs are searched.  Null and
    empty items match nothing.
    """
    names = fields or [text]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_field"), tokens(c).alias("_iw")) for k, c in enumerate(names)]))
    it = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("_item"), each.alias("x")).select("_item", "x.*").where(F.size("_iw") > 0)
    it = it.withColumn("_n", F.least(F.size("_iw"), F.lit(seed)))
    held, it = _map_of(it.select("_item", "_field", "_n", F.array_join("_iw", " ").alias("_phrase"), _gram_hash(F.array_join(F.slice("_iw", 1, F.col("_n")), " ")).alias("_gram")))
    lengths = tuple(sorted(r["_n"] for r in it.select("_n").distinct().collect()))  # at most `seed` numbers
    pairs = _grams_of(train, train_key, text, held, lengths, False).join(it.select("_item", "_field", "_phrase", "_gram"), "_gram").drop("_gram").distinct()
    line = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    tr = train.select(F.col(train_key).alias("_key"), line(F.array_join(tokens(text), " ")).alias("_text"))
    found = pairs.join(tr, "_key").where(F.contains("_text", line(F.col("_phrase"))))
    if fields:
        asked = it.groupBy("_item").agg(F.count_distinct("_field").alias("_asked"))
        found = found.groupBy("_key", "_item").agg(F.count_distinct("_field").alias("_met")).join(asked, "_item").where("_met = _asked")
    return found.select(F.col("_key").alias(train_key), F.col("_item").alias(item_key)).distinct()


def ngram_coverage(train: DataFrame, items: DataFrame, train_key: str, item_key: str, text: str = "text", n: int = 8) -> DataFrame:
    """``train_key, item_key, score``: share of the item's words in n-grams that the row holds.

    An n-gram that comes twice in an item counts at its last place only.  Items under ``n``
    words have no n-gram and match nothing.  Only n-grams that a Bloom filter of the items' knows
    leave the scan of the rows; the join is on the words themselves.
    """
    it = items.where(F.col(text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).alias("_item"), once(tokens(text)).alias("_iw"))
    it = it.withColumn("_len", F.size("_iw")).select("_item", "_len", F.posexplode(word_ngrams(F.col("_iw"), n)).alias("_pos", "_words")).groupBy("_item", "_len", "_words").agg(F.max("_pos").alias("_pos"))
    held, it = _map_of(it.withColumn("_gram", _gram_hash("_words")))
    met = _grams_of(train, train_key, text, held, (n,), True).drop("_gram").join(it.drop("_gram"), "_words").groupBy("_key", "_item", "_len").agg(F.collect_set("_pos").alias("_at"))
    covered = F.aggregate(F.array_sort("_at"), F.struct(F.lit(-n).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(n), p - a["last"])).alias("n")), lambda a: a["n"])
    return met.select(F.col("_key").alias(train_key), F.col("_item").alias(item_key), (covered / F.col("_len")).alias("score"))


def drop_contaminated(train: DataFrame, matches: DataFrame, key: str, threshold: float | None) -> DataFrame:
    """Rows without a match over the threshold (strictly); without a threshold every match removes."""
    hit = matches if threshold is None else matches.where(F.col("score") > threshold)
    return train.join(hit.select(key).distinct(), key, "left_anti")


def contamination_matrix(scores: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Mean score per row and evaluation set, one column per set, 0 where nothing matches."""
    return scores.groupBy(row).pivot(column, columns).agg(F.avg(value)).na.fill(0.0)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, query_block: int = 10_000, index_block: int = 50_000) -> DataFrame:
    """``query, hit, rank, score`` of the ``k`` nearest by dot product, score ``(1 + dot) / 2``.

    Exact: the stated queries meet all rows, block by block.  A task compares one block of
    queries with one block of the index and keeps the best ``k`` of it, so what is shuffled
    afterwards is ``k`` rows per query and block.  A row is no hit of itself; ties go to the
    lesser key; null keys and vectors are left out.
    """
    import numpy as np
    import pandas as pd

    kind = dict(index.dtypes)[key]
    q = queries.select(F.col(key).alias("qk"), F.col(vector).alias("qv")).where("qk is not null and qv is not null")
    d = index.select(F.col(key).alias("dk"), F.col(vector).alias("dv")).where("dk is not null and dv is not null")
    q_blocks, d_blocks = (max(1, -(-t.count() // size)) for t, size in ((q, query_block), (d, index_block)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = q.withColumn("qb", F.pmod(F.xxhash64("qk"), F.lit(q_blocks)).cast("int")).withColumn("db", every(d_blocks))
    d = d.withColumn("db", F.pmod(F.xxhash64("dk"), F.lit(d_blocks)).cast("int")).withColumn("qb", every(q_blocks))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            a, b = np.array(left["qv"].tolist(), dtype=np.float64), np.array(right["dv"].tolist(), dtype=np.float64)
            scores, keys = np.round(a @ b.T, 9), right["dk"].to_numpy()
            for i, qk in enumerate(left["qk"]):
                near = np.lexsort((keys, -scores[i]))[: k + 1]
                rows += [(qk, keys[j], scores[i, j]) for j in near if keys[j] != qk][:k]
        return pd.DataFrame(rows, columns=["query", "hit", "dot"])

    found = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(best, f"query {kind}, hit {kind}, dot double")
    w = Window.partitionBy("query").orderBy(F.col("dot").desc(), "hit")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "hit", "rank", ((1 + F.col("dot")) / 2).alias("score"))
