"""Exact removal of repeated passages by a logarithmic family of sparse suffix arrays.

Every window of `length` bytes picks one suffix: the one whose first SEED bytes hash lowest among
those that start in the window and leave room for a seed; about one suffix in 35. The choice depends
on the window's bytes alone, so two equal windows pick suffixes with equal seeds at equal offsets, and
the picked suffixes, ordered by seed, are a sparse suffix array that misses no repeat.

Documents come in batches of a bounded size, in the order of their ids. Each batch gets its suffix
array, sorted some documents at a time and then whole; FAN levels of equal rank merge, the rest at the end, so
a suffix is rewritten as often as the logarithm of the number of batches. Equal seeds meet as
neighbours in a batch's array or a merge of levels, where their documents are reported; one
row of a seed goes on, since a reported seed only waits for others. What a match means is settled on
the text of the documents that have matches: all windows with one suffix form a block; equal blocks
repeat whole, and different blocks of one seed are compared window by window, byte by byte.
"""

from __future__ import annotations

import gc
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .base import clear
from .shingles import Hasher, mix

SEED, CHUNK, SECOND_BASE = 32, 1 << 21, 0xC2B2AE3D27D4EB4F
#: Seeds with more different blocks than this are compared by window digests over all tasks.
CROWDED = 4096
#: Bytes of text in a batch, and the least number of batches.
BATCH_BYTES, LEAST_BATCHES = 1 << 27, 4
#: Levels of equal rank that merge into one.
FAN = 4


def let_go(spark: SparkSession) -> None:
    """Drop the shuffle files that no table in use needs: those of the last job are only free once it has ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame, name: str, *by: str) -> str:
    """Path of `df` written once, well packed, after the shuffle files of former jobs are let go."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    let_go(spark)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(settled(df, name))


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def picked(raw: np.ndarray, length: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, suffix, first window, last window) of the blocks of a text, in order; none below `length` bytes."""
    parts = []
    reach = length - SEED + 1
    for begin in range(0, max(len(raw) - length + 1, 0), CHUNK):
        own = raw[begin:begin + CHUNK + length - 1]
        sums = hasher.sums(own)
        at = np.arange(len(own) - SEED + 1)
        low = seeds = hasher.spans(sums, at, at + SEED)
        size = 1
        while size < reach:     # leftmost smallest of 1, 2, 4 ... and at last `reach` neighbours
            step = min(size, reach - size)
            right = low[step:] < low[:-step]
            at = np.where(right, at[step:], at[:-step])
            low = np.where(right, low[step:], low[:-step])
            size += step
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        parts.append((seeds[at[first]], at[first] + begin, first + begin, last + begin))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts))


def suffix_arrays(docs: DataFrame, length: int, cuts: list[float]) -> DataFrame:
    """(batch, seed, doc_id, met, head): the picked suffixes of some documents at a time, in the order of batch and seed.

    A batch ends at each of `cuts`. `met` says that the seed is there again, `head` is true for one row of each seed.
    """
    def listed(batches):
        hasher = Hasher()
        for pdf in batches:
            place = np.searchsorted(cuts, pdf["doc_id"].to_numpy(float)) if cuts else np.zeros(len(pdf), np.int64)
            seeds, counts = [], []
            for text in map(clear, pdf["text"]):
                seed, n = np.unique(picked(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), length, hasher)[0], return_counts=True)
                seeds.append(seed.view(np.int64))
                counts.append(n)
            size = [len(seed) for seed in seeds]
            part, seed, n = np.repeat(place, size), np.concatenate([*seeds, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
            order = np.lexsort((seed, part))
            part, seed = part[order], seed[order]
            met, head = neighbours(n[order], seed, part)
            yield pd.DataFrame({"batch": part, "seed": seed, "doc_id": np.repeat(pdf["doc_id"].to_numpy(), size)[order], "met": met, "head": head})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(listed, f"batch int, seed long, doc_id {kind}, met boolean, head boolean")


def neighbours(n: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: whether the equal ones have `n` over 1 together, and which are the first of them."""
    head = np.zeros(len(n), bool)
    head[:1] = True
    for key in keys:
        head[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(head)
    return np.repeat(np.add.reduceat(n, first) > 1 if len(n) else head, np.diff(first, append=len(n))), head


def merged(rows: DataFrame, *spread: str | Column) -> DataFrame:
    """(batch, seed, doc_id, met, head) sorted by seed, of such rows that are known to have met or to stand for their seed.

    Documents are reported where a seed has met, and null after that. Rows that are no head may be spread in any way.
    """
    names = ["batch", "seed", "doc_id", "met", "head"]

    def scanned(batches):
        held = []       # rows of the last seed, which may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            if len(table):
                part, seed = table["batch"].to_numpy(), table["seed"].to_numpy()
                last = np.flatnonzero((part != part[-1]) | (seed != seed[-1])).max(initial=-1) + 1
                yield from flagged(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield from flagged(pa.Table.from_batches(held))

    def flagged(table):
        part, seed, met, head = (table[c].to_numpy() for c in ("batch", "seed", "met", "head"))
        again, first = neighbours(head.astype(np.int64), seed, part)    # heads come first
        flags = [pa.array(again | met), pa.array(first & head)]
        yield from pa.Table.from_arrays([*table.columns[:3], *flags], names=names).to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(*names).repartition(*spread).sortWithinPartitions("seed", "batch", F.desc("head")).mapInArrow(
        scanned, f"batch int, seed long, doc_id {kind}, met boolean, head boolean")


class SuffixFamily:
    """Levels of suffix arrays; each has a rank, the number of batches merged into it.

    A level has one row of each seed: its document, or null where all documents with the seed are in `matches`.
    """

    def __init__(self, length: int = 100):
        self.length, self.levels, self.matches = length, [], []

    def add(self, docs: DataFrame, cuts: list[float] = ()) -> None:
        """Take in one batch, or those between `cuts` one after the other, and merge levels of equal rank."""
        # Other rows than heads are only passed on, so that a crowd of documents with one seed is spread.
        spot = F.pmod(F.when(F.col("head"), F.col("seed")).otherwise(F.xxhash64("doc_id")), F.lit(64))
        arrays = merged(suffix_arrays(docs, self.length, list(cuts)), "batch", spot)
        spark, path = docs.sparkSession, settled(arrays, "suffix-arrays", "batch")
        rows = spark.read.schema(arrays.schema).parquet(path)
        self.report(rows)
        for folder in sorted({file.rsplit("/", 1)[0] for file in rows.inputFiles()}, key=lambda folder: int(folder.rsplit("=", 1)[1])):
            self.levels.append((1, self.unmet(spark.read.schema(rows.drop("batch").schema).parquet(folder).withColumn("batch", F.lit(0)))))
            while len(self.levels) >= FAN and len({rank for rank, _ in self.levels[-FAN:]}) == 1:
                self.merge(FAN)

    def report(self, rows: DataFrame) -> None:
        """Keep the documents of seeds that met for the first time."""
        self.matches.append(settle(rows.where("met AND doc_id IS NOT NULL").select("seed", "doc_id"), "suffix-matches"))

    @staticmethod
    def unmet(rows: DataFrame) -> DataFrame:
        """One row of each seed, without its document where that was reported."""
        return rows.where("head").withColumn("doc_id", F.when(~F.col("met"), F.col("doc_id"))).withColumn("met", F.lit(False))

    def merge(self, count: int) -> None:
        """Merge the last `count` levels by seed."""
        last, self.levels = self.levels[-count:], self.levels[:-count]
        rows = last[0][1]
        for _, level in last[1:]:
            rows = rows.unionByName(level)
        rows = settle(merged(rows, "seed"), "suffix-level")
        self.report(rows)
        discard(*(level for _, level in last))
        self.levels.append((sum(rank for rank, _ in last), self.unmet(rows)))

    def matched(self) -> DataFrame:
        """(seed, doc_id) of all matches, some several times. The levels left become one, which is not needed any more."""
        if len(self.levels) > 1:
            self.merge(len(self.levels))
        discard(*(level for _, level in self.levels))
        out = self.matches[0]
        for m in self.matches[1:]:
            out = out.unionByName(m)
        return out


def block_rows(texts: DataFrame, length: int) -> DataFrame:
    """(seed, digest, doc_id, text_key, suffix, first, last) of the matched blocks of `texts`.

    Seed and digest are 64-bit hashes to different bases, so equal pairs mean equal bytes with equal offsets.
    """
    def listed(batches):
        hasher, other = Hasher(), Hasher(SECOND_BASE)
        for pdf in batches:
            found = {name: [np.zeros(0, np.int64)] for name in ("seed", "digest", "suffix", "first", "last")}
            size = []
            for text, wanted in zip(pdf["text"], pdf["seeds"]):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                seed, suffix, first, last = picked(raw, length, hasher)
                own = np.isin(seed.view(np.int64), np.asarray(wanted))
                seed, suffix, first, last = seed[own], suffix[own], first[own], last[own]
                digest = other.spans(other.sums(raw), first, last + length) + mix((suffix - first).astype(np.uint64))
                for name, values in (("seed", seed), ("digest", digest), ("suffix", suffix), ("first", first), ("last", last)):
                    found[name].append(values.view(np.int64))
                size.append(len(seed))
            yield pd.DataFrame({name: np.concatenate(values) for name, values in found.items()} | {
                "doc_id": np.repeat(pdf["doc_id"].to_numpy(), size), "text_key": np.repeat(pdf["text_key"].to_numpy(), size)})

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(listed, f"seed long, digest long, suffix long, first long, last long, doc_id {kind}, text_key long")


def block_bytes(texts: DataFrame, length: int) -> DataFrame:
    """Blocks of each text with their bytes, from arrays of (seed, suffix, first, last)."""
    def cut(batches):
        for pdf in batches:
            rows = []
            for doc_id, key, text, blocks in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], pdf["blocks"]):
                body = text.encode("utf-8", "surrogatepass")
                rows += [(x["seed"], doc_id, key, x["suffix"], x["first"], body[x["first"]:x["last"] + length], x["crowded"]) for x in blocks]
            yield pd.DataFrame(rows, columns=["seed", "doc_id", "text_key", "suffix", "first", "body", "crowded"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(cut, f"seed long, doc_id {kind}, text_key long, suffix long, first long, body binary, crowded boolean")


def repeated_windows(blocks: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, start, stop) of runs of windows that an earlier block of the same seed has at the same offset."""
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def compared(batches):
        seed, seen = None, set()
        for pdf in batches:     # sorted by seed and place; a seed's windows are forgotten with the next one
            rows = []
            for x in pdf.itertuples():
                if x.seed != seed:
                    seed, seen = x.seed, set()
                run = None
                for k in range(len(x.body) - length + 1):
                    window = (x.suffix - x.first - k, x.body[k:k + length])
                    if window in seen:
                        run = k if run is None else run
                    else:
                        seen.add(window)
                        if run is not None:
                            rows.append((x.doc_id, x.text_key, x.first + run, x.first + k - 1 + length))
                            run = None
                if run is not None:
                    rows.append((x.doc_id, x.text_key, x.first + run, x.first + len(x.body)))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "start", "stop"])

    place = ["seed", "doc_id", "text_key", "suffix"]
    near = (blocks.where("NOT crowded").select(*place, "first", "body").repartition("seed").sortWithinPartitions(*place)
            .mapInPandas(compared, f"doc_id {kind}, text_key long, start long, stop long"))

    def digested(batches):
        for pdf in batches:
            rows = [(hashlib.blake2b(x.body[k:k + length], digest_size=16).digest(), x.doc_id, x.text_key, x.first + k)
                    for x in pdf.itertuples() for k in range(len(x.body) - length + 1)]
            yield pd.DataFrame(rows, columns=["window", "doc_id", "text_key", "start"])

    # A window's digest spreads a crowded seed over all tasks; first places combine before the shuffle.
    windows = blocks.where("crowded").select("suffix", "doc_id", "text_key", "first", "body").mapInPandas(
        digested, f"window binary, doc_id {kind}, text_key long, start long")
    spot = F.struct("doc_id", "text_key", "start")
    first = windows.groupBy("window").agg(F.min(spot).alias("spot")).select("spot.*")
    far = windows.select("doc_id", "text_key", "start").join(first, ["doc_id", "text_key", "start"], "left_anti").withColumn("stop", F.col("start") + length)
    return near.unionByName(far)


def remove_repeats(docs: DataFrame, length: int = 100, batches: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans for every row of `docs`.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    text. Null texts are empty. Rows of one doc_id with different texts are ordered by a hash of the text, equal rows are one
    document and get equal results; rows with a null doc_id take no part and lose nothing. Without `batches`
    their number follows the bytes of text.
    """
    ids = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    if batches is None:
        batches = max(LEAST_BATCHES, math.ceil((ids.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BATCH_BYTES))
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / batches for k in range(1, batches)], min(0.01, 0.1 / batches)))) if batches > 1 else []
    family = SuffixFamily(length)
    family.add(ids, cuts)
    wanted = family.matched().groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    texts = settle(ids.join(wanted, "doc_id").withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"])
                   .select("doc_id", "text_key", "text", "seeds"), "suffix-texts")
    discard(*family.matches)
    blocks = settle(block_rows(texts, length), "suffix-blocks")
    same = ["seed", "digest"]
    place = F.struct("doc_id", "text_key", "suffix", "first", "last")
    first = settle(blocks.groupBy(*same).agg(F.min(place).alias("place"), F.count("*").alias("n")), "suffix-first")
    again = settle(blocks.join(first.where("n > 1").select(*same, F.col("place.doc_id").alias("a"), F.col("place.text_key").alias("b"), F.col("place.first").alias("c")), same)
                   .where("NOT (doc_id = a AND text_key = b AND first = c)").select("doc_id", "text_key", F.col("first").alias("start"), (F.col("last") + length).alias("stop")), "suffix-again")
    discard(blocks)
    several = first.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1")
    differ = (first.join(several, "seed").select("place.doc_id", "place.text_key", F.struct(
        "seed", "place.suffix", "place.first", "place.last", (F.col("kinds") > CROWDED).alias("crowded")).alias("x"))
              .groupBy("doc_id", "text_key").agg(F.collect_list("x").alias("blocks")))
    bare = texts.select("doc_id", "text_key", "text")
    bodies = settle(block_bytes(bare.join(differ, ["doc_id", "text_key"]), length), "suffix-bodies")
    runs = again.unionByName(repeated_windows(bodies, length))
    spans = settle(runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "suffix-spans")
    discard(again, first, bodies)
    let_go(docs.sparkSession)

    def kept(frames):
        for pdf in frames:
            rows = []
            for doc_id, key, text, found in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], pdf["spans"]):
                body, joined = text.encode("utf-8", "surrogatepass"), []
                for x in found:
                    if joined and x["start"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], x["stop"])
                    else:
                        joined.append([x["start"], x["stop"]])
                digest, at = hashlib.sha256(), 0
                for start, stop in joined:
                    digest.update(body[at:start])
                    at = stop
                digest.update(body[at:])
                rows.append((doc_id, key, sum(b - a for a, b in joined), len(joined), digest.hexdigest(), joined))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256", "removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = bare.join(spans, ["doc_id", "text_key"]).mapInPandas(
        kept, f"doc_id {kind}, text_key long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>")
    body = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("own"))
    return whole.join(cut, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<array<bigint>>")).alias("removed"))
