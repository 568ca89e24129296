"""Language-model scores by context-tree weighting, beside a smoothed unigram base.

A byte is eight binary decisions, a path of nodes from 1 to 255. Each node has a context tree of
its own over the `DEPTH` whole bytes before it. Every context seen in training is kept, so the model
grows with the corpus. A tree node weighs its own Krichevsky-Trofimov estimate against the product
of its children, and a prediction mixes the estimates of all depths along its path by those weights.
Byte 255, which no UTF-8 text has, ends a text, so the probabilities of all texts sum to one; it
also fills the contexts before a text's start.

A gram is a context, the nearest byte first, with the byte that follows, in one 64-bit number. Parts
of the corpus list their distinct grams by bucket, a hash of the nearest `CUT` bytes. A bucket holds
every context below those bytes, so it weighs its subtrees alone and hands up rows (gram, count, log
weights); depths 2, 1 and 0 follow, one grouping each, and the weights go down the same way. Grams
without training text have zero counts. The answers return to the part that listed the grams.

The base needs the corpus count of every word. Hashed words and their documents go to buckets of
the vocabulary, which send back partial sums per document; words that make up 1 / `HOT` or more of
all tokens (no more than `HOT` exist) are settled where the text is read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .base import clear, fold, pieces
from .shingles import Hasher

END_BYTE, HOT = 255, 2000
#: The end of a text among the hashed words, and words a bucket of the vocabulary holds on average.
END_TOKEN, BUCKET_WORDS = 0, 50_000
#: Bytes of text after which a task hands on what it has counted or listed.
FLUSH = 8 << 20
#: Bytes of context, the depth at which subtrees are dealt to buckets, and bytes of text a bucket serves on average.
DEPTH, CUT, BUCKET_BYTES = 7, 3, 1 << 22


def grams(text: str):
    """Arrays of grams over the whole text and its end, piece by piece."""
    tail = np.full(DEPTH, END_BYTE, np.uint64)
    every = list(pieces(text))
    for k, piece in enumerate(every):
        raw = np.frombuffer(piece.encode("utf-8", "surrogatepass") + (bytes([END_BYTE]) if k == len(every) - 1 else b""), np.uint8)
        whole = np.concatenate((tail, raw.astype(np.uint64)))
        key = whole[DEPTH:].copy()
        for back in range(1, DEPTH + 1):
            key |= whole[DEPTH - back:len(whole) - back] << np.uint64(64 - 8 * back)
        yield key
        tail = whole[len(whole) - DEPTH:]


def shortened(key: np.ndarray, depth: int) -> np.ndarray:
    """Grams with the nearest `depth` bytes of context only."""
    return key & np.uint64(((1 << 8 * depth) - 1) << (64 - 8 * depth) | 255)


def bucket_of(key: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Bucket of the nearest `depth` bytes."""
    near = (key >> np.uint64(64 - 8 * depth)) * np.uint64(0x9E3779B97F4A7C15)
    return ((near >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - shift


TABLE = lgamma(np.arange(1 << 13) / 2 + 0.5)


def half_lgamma(twice: np.ndarray) -> np.ndarray:
    """lgamma((twice + 1) / 2) of whole numbers."""
    small = twice < len(TABLE)
    out = TABLE[np.where(small, twice, 0)]
    if not small.all():
        out[~small] = lgamma(twice[~small] / 2 + 0.5)
    return out


def climb(key: np.ndarray, n: np.ndarray, deep: int, top: int, leaf: np.ndarray | None = None) -> list[dict]:
    """Depths `top` to `deep` of the tree over sorted distinct grams: per gram and bit, log weighted
    probability of the node, weight of its own estimate, and own probability of the gram's bit.

    The deepest contexts weigh as `leaf` (rows of grams, columns of bits) says, or by their own estimates.
    """
    found, up, below = [], None, None
    for depth in range(deep, top - 1, -1):
        if depth < deep:
            key, up = np.unique(shortened(key, depth), return_inverse=True)
            n = np.bincount(up, n, len(key)).astype(np.int64)
        change = key[1:] ^ key[:-1]
        log, share, p = (np.empty((len(key), 8)) for _ in range(3))
        for level in range(8):
            run = np.concatenate(([0], np.cumsum((change >> np.uint64(8 - level)) != 0)))
            bit = (key >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
            all_ = np.bincount(run, n).astype(np.int64)
            ones = np.bincount(run, n * bit).astype(np.int64)
            own = half_lgamma(2 * ones) + half_lgamma(2 * (all_ - ones)) - half_lgamma(2 * all_ + 1) - np.log(np.pi)
            if depth == deep:
                log[:, level], share[:, level] = own[run] if leaf is None else leaf[:, level], 1.0
            else:
                first, weight = below[level]
                children = np.bincount(run[up[first]], weight, len(own))
                whole = np.logaddexp(own, children) - np.log(2)
                log[:, level], share[:, level] = whole[run], np.exp(own - np.log(2) - whole)[run]
            p[:, level] = (np.where(bit, ones[run], (all_ - ones)[run]) + 0.5) / (all_[run] + 1)
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            found_level = (first, log[first, level])
            below_next = [found_level] if level == 0 else [*below_next, found_level]
        below = below_next
        found.append({"key": key, "n": n, "log": log, "share": share, "p": p, "up": up})
    return found[::-1]


def descend(tree: list[dict], sure: np.ndarray, rest: np.ndarray, leaf: bool) -> tuple[np.ndarray, np.ndarray]:
    """Probability settled so far and weight left, per gram and bit, from the top depth to the deepest; with `leaf` that one is not mixed in."""
    for k, at in enumerate(tree):
        if not (leaf and k == len(tree) - 1):
            sure, rest = sure + rest * at["share"] * at["p"], rest * (1 - at["share"])
        if k + 1 < len(tree):
            sure, rest = sure[at["up"]], rest[at["up"]]
    return sure, rest


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the nodes 1..255 of each row of byte counts (column 0 is unused)."""
    zeros, ones = np.zeros(counts.shape), np.zeros(counts.shape)
    below = counts
    for level in range(7, -1, -1):
        zeros[:, 1 << level:2 << level], ones[:, 1 << level:2 << level] = below[:, ::2], below[:, 1::2]
        below = below[:, ::2] + below[:, 1::2]
    return zeros, ones


def estimate(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Krichevsky-Trofimov: log block probability, and probability that the next bit is one."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1) - np.log(np.pi), (ones + 0.5) / (zeros + ones + 1)


def weighted(counts: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of inner nodes: log weighted probability, weight of the own estimate, own probability of a one."""
    log_own, p = estimate(*decisions(counts))
    log_all = np.logaddexp(log_own, log_children) - np.log(2)
    return log_all, np.exp(log_own - np.log(2) - log_all), p


def tree_weights(counts: np.ndarray) -> np.ndarray:
    """Dense form of the same recursion for a tree of depth 3 over 64, 32 and 32 classes, to test against:
    log10 probability of each byte in each deepest context, float32[2^16, 256] from counts of the same shape."""
    shape = counts.reshape(64, 32, 32, 256)
    by_near, log_near = shape.sum(axis=(1, 2)).astype(float), np.zeros((64, 256))
    inner = []
    for c in range(64):     # one class of the last byte at a time, to bound memory
        deep_log, deep_p = estimate(*decisions(shape[c].reshape(1024, 256).astype(float)))
        log2, own2, p2 = weighted(shape[c].sum(axis=1).astype(float), deep_log.reshape(32, 32, 256).sum(axis=1))
        inner.append((own2, p2))
        log_near[c] = log2.sum(axis=0)
    log1, own1, p1 = weighted(by_near, log_near)
    _, own0, p0 = weighted(by_near.sum(axis=0, keepdims=True), log1.sum(axis=0, keepdims=True))
    out = np.empty((64, 1024, 256), np.float32)
    for c in range(64):
        _, deep_p = estimate(*decisions(shape[c].reshape(1024, 256).astype(float)))
        own2, p2 = (np.repeat(x, 32, axis=0) for x in inner[c])
        p = own2 * p2 + (1 - own2) * deep_p
        p = own1[c] * p1[c] + (1 - own1[c]) * p
        p = own0[0] * p0[0] + (1 - own0[0]) * p
        log = np.zeros((1024, 256))
        for bit in range(8):
            byte = np.arange(256)
            node, value = (256 | byte) >> (8 - bit), (byte >> (7 - bit)) & 1
            log += np.log10(np.where(value, p[:, node], 1 - p[:, node]))
        out[c] = log
    return out.reshape(1 << 16, 256)


def counted(batches):
    """(token, n) of training rows: hashed words with the end."""
    hasher = Hasher()

    def handed(words: list):
        token, n = np.unique(np.concatenate(words), return_counts=True)
        yield pd.DataFrame({"token": token.view(np.int64), "n": n})

    words, size = [], 0
    for pdf in batches:
        for text in map(clear, pdf["text"]):
            words += [hasher.words(text), np.array([END_TOKEN], np.uint64)]
            size += len(text) + 1
            if size >= FLUSH:
                yield from handed(words)
                words, size = [], 0
    if size:
        yield from handed(words)


def smallest(values: np.ndarray) -> bytes:
    """Unsigned values in as few bytes as they need, the width first."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def packed(key: np.ndarray) -> bytes:
    """Sorted grams byte plane by byte plane, compressed."""
    return zlib.compress(key.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


def merged(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of one bucket, sorted, and their training counts."""
    key, at = np.unique(np.concatenate([unpacked(x) for x in lists["grams"]]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([widened(x) for x in lists["train"]])).astype(np.int64)


def handed_up(tree: list[dict]) -> pd.DataFrame:
    top = tree[0]
    return pd.DataFrame({"gram": top["key"].view(np.int64), "n": top["n"], "log": list(top["log"])})


def taken(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted grams, counts and log weights of rows handed up."""
    key = rows["gram"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(key)
    return key[by], rows["n"].to_numpy()[by], np.stack(rows["log"].to_numpy())[by]


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of `docs`.

    Both models learn from all whole texts outside fold `held`; null texts are empty ones, which have the end token only.
    Repeated rows are learned and scored each. Without training rows, counts are zero and the tree predicts evenly.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (fold(folds) == held).alias("held_out"))
    words = materialise(rows.where("NOT held_out").select("text").mapInPandas(counted, "token long, n long")
                        .groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")
    facts = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    total, types = facts["tokens"] or 0, facts["types"]
    hot = words.where(F.col("n") * HOT >= total).limit(HOT).toPandas().sort_values("token")
    shares = max(16, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    hot_tokens = hot["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hot_tokens)
    hot_tokens, hot_counts = hot_tokens[order], hot["n"].to_numpy()[order]
    buckets = max(16, -(-types // BUCKET_WORDS))
    divide = total + 0.1 * (types + 1)

    def listed(batches):
        """Documents with what is settled here, and the other words by bucket: token, rows of its documents, counts there."""
        hasher = Hasher()
        part, flush = TaskContext.get().partitionId(), 0
        found, kept, seen, size = [], [], ([], []), 0

        def handed(chunk: int):
            tokens = np.concatenate([f[0] for f in found])
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            often = np.concatenate([f[1] for f in found])
            by = np.lexsort((doc, tokens, tokens % np.uint64(buckets)))
            tokens, doc, often = tokens[by], doc[by], often[by]
            edge = np.searchsorted(tokens % np.uint64(buckets), np.arange(buckets + 1, dtype=np.uint64))
            blobs = []
            for b in range(buckets):
                low, high = edge[b], edge[b + 1]
                if low < high:
                    token, holders = np.unique(tokens[low:high], return_counts=True)
                    blobs.append({"bucket": b, "chunk": chunk, "tokens": token.tobytes(), "holders": smallest(holders),
                                  "docs": smallest(doc[low:high]), "often": smallest(often[low:high])})
            yield pd.DataFrame(kept).assign(chunk=chunk, row=np.arange(len(kept))).reindex(columns=names)
            if blobs:
                yield pd.DataFrame(blobs).reindex(columns=names)
            train, n = np.unique(np.concatenate(seen[0]), return_counts=True) if seen[0] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            every = np.unique(np.concatenate([train, *seen[1]]))
            counts = np.zeros(len(every), np.int64)
            counts[np.searchsorted(every, train)] = n
            share = bucket_of(every, CUT, shares)
            by = np.argsort(share, kind="stable")
            edge = np.searchsorted(share[by], np.arange(shares + 1))
            yield pd.DataFrame([{"chunk": chunk, "share": b, "grams": packed(every[by[low:high]]), "train": smallest(counts[by[low:high]])}
                                for b, (low, high) in enumerate(zip(edge[:-1], edge[1:])) if low < high]).reindex(columns=names)

        for pdf in batches:
            for doc_id, text, held_out in zip(pdf["doc_id"], map(clear, pdf["text"]), pdf["held_out"]):
                token, often = np.unique(np.append(hasher.words(text), np.uint64(END_TOKEN)), return_counts=True)
                at = np.searchsorted(hot_tokens, token)
                here = at < len(hot_tokens)
                here[here] = hot_tokens[at[here]] == token[here]
                base = float((often[here] * np.log10((hot_counts[at[here]] + 0.1) / divide)).sum())
                own = list(grams(text))
                length = sum(map(len, own))
                seen[bool(held_out)].extend(own)
                kept.append({"doc_id": doc_id, "held_out": held_out, "n_tokens": int(often.sum()), "n_known": int(often[here].sum()),
                             "base_score": base, "text": text.encode("utf-8", "surrogatepass"), "n_bytes": length - 1})
                found.append((token[~here], often[~here]))
                size += length + 1000
                if size >= FLUSH:
                    yield from handed((part << 20) | flush)
                    flush, found, kept, seen, size = flush + 1, [], [], ([], []), 0
        if kept:
            yield from handed((part << 20) | flush)

    names = ["chunk", "row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "text", "n_bytes", "bucket", "tokens", "holders", "docs", "often",
             "share", "grams", "train"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = materialise(rows.mapInPandas(listed, f"chunk long, row int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                                        "base_score double, text binary, n_bytes long, bucket int, tokens binary, holders binary, docs binary, often binary, "
                                        "share int, grams binary, train binary"),
                       "lm-lists")

    def answered(lists: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Partial sums of one bucket of words, for each chunk of documents."""
        tokens = known["token"].to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(tokens)
        tokens, n = tokens[by], known["n"].to_numpy()[by]
        out = []
        for x in lists.itertuples():
            own = np.frombuffer(x.tokens, np.uint64)
            at = np.searchsorted(tokens, own)
            c = np.zeros(len(own), np.int64)
            hit = at < len(tokens)
            hit[hit] = tokens[at[hit]] == own[hit]
            c[hit] = n[at[hit]]
            holders, doc, often = widened(x.holders), widened(x.docs).astype(np.int64), widened(x.often).astype(np.int64)
            c = np.repeat(c, holders)
            rows_, at = np.unique(doc, return_inverse=True)
            out.append((x.chunk, smallest(rows_), np.bincount(at, often * np.log10((c + 0.1) / divide)).tobytes(),
                        smallest(np.bincount(at, often * (c > 0)).astype(np.int64))))
        return pd.DataFrame(out, columns=["chunk", "rows", "base", "known"])

    bucket = F.expr(f"cast(pmod(token % {buckets} + IF(token < 0, {(1 << 64) % buckets}, 0), {buckets}) as int)")
    partial = (both.where("bucket IS NOT NULL").select("bucket", "chunk", "tokens", "holders", "docs", "often").groupBy("bucket")
               .cogroup(words.where(F.col("n") * HOT < total).withColumn("bucket", bucket).groupBy("bucket"))
               .applyInPandas(answered, "chunk long, rows binary, base binary, known binary"))

    lists = both.where("share IS NOT NULL").select("share", "chunk", "grams", "train")
    up = "gram long, n long, log array<double>"
    below = materialise(lists.groupBy("share").applyInPandas(lambda x: handed_up(climb(*merged(x), DEPTH, CUT)), up), "lm-subtrees")
    near = F.pmod(F.xxhash64(F.expr("shiftrightunsigned(gram, 48)")), F.lit(shares))

    def second(x: pd.DataFrame) -> list[dict]:
        key, n, log = taken(x)
        return climb(key, n, CUT, 2, log)

    def first(x: pd.DataFrame) -> pd.DataFrame:
        key, n, log = taken(x)
        tree = climb(key, n, 2, 1, log)
        return handed_up(tree).assign(share=list(tree[0]["share"]), p=list(tree[0]["p"]))

    # At most 2^16 rows whatever the corpus: a byte and the one before.
    last = (below.groupBy(near).applyInPandas(lambda x: handed_up(second(x)), up).groupBy(F.expr("shiftrightunsigned(gram, 56)"))
            .applyInPandas(first, f"{up}, share array<double>, p array<double>").toPandas())
    if len(last):
        last = last.iloc[np.argsort(last["gram"].to_numpy().astype(np.int64).view(np.uint64))]
        key, n, log = taken(last)
        sure, rest = descend(climb(key, n, 1, 0, log), np.zeros((1, 1)), np.ones((1, 1)), True)
        share, p = (np.stack(last[c].to_numpy()) for c in ("share", "p"))
        sent = spark.sparkContext.broadcast((key, sure + rest * share * p, rest * (1 - share)))
    else:
        sent = spark.sparkContext.broadcast(None)

    def down(x: pd.DataFrame) -> pd.DataFrame:
        """Settled probability and weight left of the grams at depth `CUT`."""
        tree, (known, sure, rest) = second(x), sent.value
        at = np.searchsorted(known, shortened(tree[0]["key"], 1))
        sure, rest = descend(tree, sure[at], rest[at], True)
        key = tree[-1]["key"]
        return pd.DataFrame({"share": bucket_of(key, CUT, shares), "gram": key.view(np.int64), "sure": list(sure), "rest": list(rest)})

    def weighed(x: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """log10 probability of each listed gram of one bucket."""
        key, n = merged(x)
        tree = climb(key, n, DEPTH, CUT)
        above = above.iloc[np.argsort(above["gram"].to_numpy().astype(np.int64).view(np.uint64))]
        sure, _ = descend(tree, np.stack(above["sure"].to_numpy()), np.stack(above["rest"].to_numpy()), False)
        log = np.log10(sure).sum(axis=1).astype(np.float32)
        return pd.DataFrame([(c, s, log[np.searchsorted(key, unpacked(g))].tobytes()) for c, s, g in zip(x["chunk"], x["share"], x["grams"])],
                            columns=["chunk", "share", "logs"])

    answers = (lists.groupBy("share").cogroup(below.groupBy(near).applyInPandas(
        down, "share int, gram long, sure array<double>, rest array<double>").groupBy("share")).applyInPandas(weighed, "chunk long, share int, logs binary"))
    partial = partial.unionByName(answers, allowMissingColumns=True)

    def settled(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        """Documents of one chunk with the sums of all buckets."""
        told, parts = parts[parts["logs"].notna()].sort_values("share"), parts[parts["logs"].isna()]
        own = own.sort_values("row")
        keys = [k for text in own["text"] for k in grams(text.decode("utf-8", "surrogatepass"))]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        log = np.empty(len(found))
        log[np.argsort(bucket_of(found, CUT, shares), kind="stable")] = np.concatenate([np.frombuffer(x, np.float32) for x in told["logs"]])
        starts = np.concatenate(([0], np.cumsum(own["n_bytes"].to_numpy() + 1)[:-1])).astype(np.int64)
        own = own.drop(columns="text").assign(score=np.add.reduceat(log[at], starts))
        own = own.sort_values("row").reset_index(drop=True)
        base, known = own["base_score"].to_numpy(float).copy(), own["n_known"].to_numpy(np.int64).copy()
        for x in parts.sort_values(["rows", "base"]).itertuples():
            at = widened(x.rows).astype(np.int64)
            base[at] += np.frombuffer(x.base)
            known[at] += widened(x.known).astype(np.int64)
        return own.assign(base_score=base, n_known=known)

    result = (both.where("n_bytes IS NOT NULL").select("chunk", "row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "text", "n_bytes")
              .groupBy("chunk").cogroup(partial.groupBy("chunk"))
              .applyInPandas(settled, f"chunk long, row int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, "
                             "n_bytes long, score double"))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * 3.321928094887362 / F.col("n_bytes"))
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
                         bits.alias("bits_per_byte"))
