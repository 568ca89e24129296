"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its smallest and its largest
image, so `bands * rows / 2` permutations fill `bands` bands of `rows` values. Documents with
equal sets are one node. A first round tests each member of a bucket (band, values) against the
bucket's first one, on full sets, and joins components. Nodes of buckets that still hold several
components go on with their rarest shingles, of which two linked sets must share one: per such
shingle, round r tests 16^r members, those after the ones of earlier rounds, against the later ones of
other components. So copies cost one comparison each, every pair that no chain of links joins is tested
in the end, and no group is paired with itself. With the defaults two sets at the threshold
share no band with probability (1 - 0.8^5)^40 = 1.2e-7.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialise
from .base import clear
from .components import components
from .shingles import Hasher, mix

#: Shingles hashed at once, to stay within the processor's cache.
AT_ONCE = 1 << 15


def permutations(count: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, np.uint64), rng.integers(0, 1 << 63, count, np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """[sets, bands] hashes of the bands of non-empty sets; minimum and maximum of a permutation are neighbours."""
    flip, factor = permutations((bands * rows + 1) // 2)
    values = np.empty((2 * len(flip), len(sets)), np.uint64)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= AT_ONCE):
            size += len(sets[end])
            end += 1
        joint = np.concatenate(sets[begin:end])
        at = np.cumsum([0, *map(len, sets[begin:end - 1])])
        for k in range(len(flip)):
            image = (joint ^ flip[k]) * factor[k]
            values[2 * k, begin:end] = np.minimum.reduceat(image, at)
            values[2 * k + 1, begin:end] = np.maximum.reduceat(image, at)
        begin = end
    out = np.zeros((bands, len(sets)), np.uint64)
    for k in range(bands * rows):
        out[k // rows] = mix(out[k // rows] * np.uint64(31) + values[k])
    return out.T


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, n (set size), k1 and k2 (digest of the set), band hashes (none for an empty set)."""
    def sketched(batches):
        hasher = Hasher()
        for pdf in batches:
            sets = [hasher.shingles(clear(t), words) for t in pdf["text"]]
            full = [k for k, s in enumerate(sets) if len(s)]
            bands_of = [np.zeros(0, np.int64)] * len(sets)
            if full:
                for k, row in zip(full, signatures([sets[k] for k in full], bands, rows).view(np.int64)):
                    bands_of[k] = row
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(s) for s in sets],
                                "k1": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                                "k2": np.array([mix(s + np.uint64(7)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                                "bands": bands_of})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(sketched, f"doc_id {kind}, n long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def listed(batches):
        hasher = Hasher()
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["doc_id"], "items": [hasher.shingles(clear(t), words).tobytes() for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(listed, f"node {kind}, items binary")


@F.pandas_udf(LongType())
def shared(left: pd.Series, right: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                      for a, b in zip(left, right)], dtype="int64")


def prefixes(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, place): the rarest shingles of each node, as many as two linked sets must share one of.

    A set of n linked to another shares at least ceil(percent n / 100) of its shingles, so under any common order the first
    n - that + 1 of both have one in common. Rarest first, an edited copy's own shingles come before those of its group.
    """
    def listed(batches):
        for pdf in batches:
            items = [np.frombuffer(x, np.int64) for x in pdf["items"]]
            size = [len(x) for x in items]
            yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), size), "n": np.repeat(size, size),
                                "token": np.concatenate(items) if items else np.zeros(0, np.int64)})

    kind = sets.schema["node"].dataType.simpleString()
    tokens = materialise(sets.join(nodes, "node", "left_semi").mapInPandas(listed, f"node {kind}, n long, token long"), "minmax-tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("holders"))
    order = Window.partitionBy("node").orderBy("holders", "token")
    return (tokens.join(common, "token").withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("holders > 1").select("token", "node", "n", "place"))


def numbered(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of keys that have several, numbered in the order of their ids."""
    crowded = members.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1")
    return members.join(crowded, keys).withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("node")) - 1)


def first_hub(step: int) -> int:
    """Number of the first member that a round tests against later ones: 0, 1, 17, 273 ... so rounds are few."""
    return (16 ** step - 1) // 15


class Links:
    """The pairs tested so far, and the component of each linked node."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.tested = self.labels = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def divided(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Members of those keys whose members are not all in one component."""
        rows = self.labelled(rows)
        mixed = rows.groupBy(*keys).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(*keys)
        return rows.join(mixed, keys, "left_semi").drop("component")

    def test(self, buckets: DataFrame, keys: list[str], step: int) -> None:
        """Test the members numbered `first_hub(step)` to `first_hub(step + 1) - 1` of each bucket against later ones of other components.

        `place` is a key's place in the common order of a set's shingles. Two sets share no more than their first common one
        and what comes after it in both, so a pair is left out at places too late to reach the overlap it needs.
        """
        low, high, percent = first_hub(step), first_hub(step + 1), self.percent
        open_ = self.labelled(buckets.where(F.col("members") > low + 1))
        hubs = open_.where((F.col("number") >= low) & (F.col("number") < high)).select(
            *keys, F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("number").alias("hub_number"), F.col("component").alias("hub_component"),
            F.col("place").alias("hub_place"))
        pairs = (open_.join(hubs, keys)
                 .where((F.col("number") > F.col("hub_number")) & (F.col("component") != F.col("hub_component"))
                        & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
                        & ((100 + percent) * (F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place")) + 1)
                           >= percent * (F.col("n") + F.col("hub_n"))))
                 .select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct())
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        pairs = materialise(pairs, "minmax-pairs")
        if pairs.isEmpty():
            return
        a = self.sets.select(F.col("node").alias("u"), F.col("items").alias("a"))
        b = self.sets.select(F.col("node").alias("v"), F.col("items").alias("b"))
        found = pairs.join(b, "v").join(a, "u").withColumn("both", shared("a", "b"))
        union = F.length("a") / 8 + F.length("b") / 8 - F.col("both")
        fresh = materialise(found.where(100 * F.col("both") >= percent * union).select("u", "v").distinct(), "minmax-links")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        if not fresh.isEmpty():
            # The stars found before stand for all their links.
            known = fresh if self.labels is None else fresh.unionByName(self.labels.select(F.col("node").alias("u"), F.col("component").alias("v")))
            self.labels = components(known)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Links join documents with 100 * intersection >= percent * union of their sets of word shingles. Null or wordless texts
    have an empty set and no link. Rows of one doc_id are one document; a null doc_id links with nothing and is kept.
    """
    sketched = materialise(sketch(docs, words, bands, rows), "minmax-sketch")
    nodes = (sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2")
             .agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.first("bands").alias("bands")))
    buckets = materialise(numbered(nodes.select("node", "n", F.posexplode("bands").alias("band", "value"), F.lit(1).alias("place")), ["band", "value"]), "minmax-buckets")
    labels = None
    if not buckets.isEmpty():
        wanted = buckets.select(F.col("node").alias("doc_id")).distinct()
        sets = materialise(full_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), words), "minmax-sets")
        found = Links(sets, percent)
        found.test(buckets, ["band", "value"], 0)
        rest = materialise(found.divided(buckets, ["band", "value"]).select("node").distinct(), "minmax-rest")
        if not rest.isEmpty():
            tokens = numbered(materialise(prefixes(sets, rest, percent), "minmax-prefixes"), ["token"])
            tokens = materialise(found.divided(tokens, ["token"]), "minmax-divided")
            largest, step = tokens.agg(F.max("members")).first()[0] or 0, 0
            while first_hub(step) + 1 < largest:
                found.test(tokens, ["token"], step)
                step += 1
        labels = found.labels
    own = sketched.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    of_set = nodes.select("k1", "k2", "node")
    if labels is not None:
        of_set = of_set.join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    else:
        of_set = of_set.select("k1", "k2", F.col("node").alias("component"))
    out = own.join(of_set, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
