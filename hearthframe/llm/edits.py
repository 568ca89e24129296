"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

Leaves hold the length and token count of one pre-token each, in blocks; the tree above the blocks
holds sums of characters and tokens. An edit descends to the blocks it touches, splits anew from
the last pre-token that the edit cannot have changed until a boundary of the old split comes up
again, replaces those leaves, and repairs the sums on the path to the root.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import clear

#: Splits text before the merges of the rank files; fixed, must match the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters behind a pre-token that can decide where it ends (the longest contraction less one, or the look-ahead).
LOOK = 3
BLOCK, REMEMBERED = 128, 500_000


class Counter:
    """Token counts of pre-tokens under one rank table."""

    def __init__(self, ranks: dict):
        import regex
        import tiktoken

        self.split = regex.compile(PATTERN)
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.known.get(token)
        if n is None:
            n = len(self.encoding.encode_ordinary(token))
            if len(token) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of all pre-tokens."""
        tokens = self.split.findall(text)
        get = self.known.get
        return list(map(len, tokens)), [get(t) or self.count(t) for t in tokens]


class TokenTree:
    """Segment tree of one document: leaf blocks below, sums of (characters, tokens) above."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.blocks = [(lengths[i:i + BLOCK], counts[i:i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.raise_sums()

    def raise_sums(self) -> None:
        """All sums, level by level; node k of a level covers nodes 2k and 2k + 1 below."""
        level = [(sum(b[0]), sum(b[1])) for b in self.blocks]
        self.levels = [level]
        while len(level) > 1:
            level = [(level[k][0] + (level[k + 1][0] if k + 1 < len(level) else 0), level[k][1] + (level[k + 1][1] if k + 1 < len(level) else 0))
                     for k in range(0, len(level), 2)]
            self.levels.append(level)

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    @property
    def characters(self) -> int:
        return self.levels[-1][0][0]

    def find(self, at: int) -> tuple[int, int]:
        """(block, its first character) of the block that holds character `at`, the last one beyond the end."""
        k, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            k *= 2
            if k + 1 < len(level) and begin + level[k][0] <= at:
                begin += level[k][0]
                k += 1
        return k, begin

    def repair(self, k: int) -> None:
        """Sums of block k and of its ancestors."""
        self.levels[0][k] = (sum(self.blocks[k][0]), sum(self.blocks[k][1]))
        for below, level in zip(self.levels, self.levels[1:]):
            k //= 2
            pair = below[2 * k:2 * k + 2]
            level[k] = (sum(p[0] for p in pair), sum(p[1] for p in pair))

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
        """Replace text[start:end] by `new`: the new text, and how many pre-tokens were encoded anew."""
        after = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        first, begin = self.find(max(0, start - LOOK))
        ends = [begin, *accumulate(self.blocks[first][0], initial=begin)][1:]
        keep = max(0, bisect_right(ends, start - LOOK) - 1)     # leaves of the first block that stay
        at = ends[keep] if keep < len(ends) else begin
        # Old boundaries behind the edit, block by block, as far as the new split has to go.
        last, old_begin = self.find(end)
        bounds = set(accumulate(self.blocks[last][0], initial=old_begin))
        lengths, counts = [], []
        for m in counter.split.finditer(after, at):
            if m.start() >= start + len(new):
                old = m.start() - shift
                while old > old_begin + sum(self.blocks[last][0]) and last + 1 < len(self.blocks):
                    old_begin += sum(self.blocks[last][0])
                    last += 1
                    bounds = set(accumulate(self.blocks[last][0], initial=old_begin))
                if old in bounds and old >= end:
                    break
            lengths.append(m.end() - m.start())
            counts.append(counter.count(m.group()))
        else:
            old, last = len(text), len(self.blocks) - 1
            old_begin = len(text) - sum(self.blocks[last][0])
        rest = bisect_right(list(accumulate(self.blocks[last][0], initial=old_begin)), old) - 1
        head, tail = self.blocks[first], self.blocks[last]
        joint = (head[0][:keep] + lengths + tail[0][rest:], head[1][:keep] + counts + tail[1][rest:])
        if first == last and len(joint[0]) <= 2 * BLOCK:
            self.blocks[first] = joint
            self.repair(first)
        else:   # blocks split or merge: the leaves stay, the sums above are raised again
            self.blocks[first:last + 1] = [(joint[0][i:i + BLOCK], joint[1][i:i + BLOCK]) for i in range(0, len(joint[0]), BLOCK)] or [([], [])]
            self.raise_sums()
        return after, len(lengths)


def load_ranks(path: str) -> dict:
    """Ranks of a byte-level vocabulary file (base64 token and rank on each line), read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def count_through_edits(docs: DataFrame, ranks: dict, edits: str = "edits") -> DataFrame:
    """Token counts of every row before and after its edits, from whole texts.

    `edits` is an array of (start, end, new) in code points, applied in order, each to the text the one before left;
    bounds are cut to the text, null edits or texts count as none or empty. Returns doc_id, n_tokens, n_pretokens,
    n_edits, n_encoded_again, n_chars_after and n_tokens_after.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["n_tokens", "n_pretokens", "n_edits", "n_encoded_again", "n_chars_after", "n_tokens_after"]

    def counted(batches):
        counter = Counter(sent.value)
        for pdf in batches:
            rows = []
            for text, changes in zip(map(clear, pdf["text"]), pdf["edits"]):
                lengths, counts = counter.leaves(text)
                tree = TokenTree(lengths, counts)
                before, again = tree.tokens, 0
                changes = [] if changes is None else [c for c in changes if c is not None]
                for c in changes:
                    start = min(max(0, c["start"] or 0), len(text))
                    text, n = tree.edit(text, start, min(max(start, c["end"] or 0), len(text)), c["new"] or "", counter)
                    again += n
                rows.append((before, len(lengths), len(changes), again, tree.characters, tree.tokens))
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=np.int64)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.col(edits).alias("edits")).mapInPandas(
        counted, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def own_edits(docs: DataFrame) -> DataFrame:
    """`docs` with two edits of each text made from the text itself: a replacement, then an insertion of a passage of it."""
    size, spot = F.length("text"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = (spot % (size + 1)).cast("int")
    second = (F.shiftright(spot, 7) % (size + 1)).cast("int")
    change = [F.struct(first.alias("start"), (first + 12).alias("end"), F.substring("text", 3, 17).alias("new")),
              F.struct(second.alias("start"), second.alias("end"), F.expr("substring(text, cast(length(text) / 2 as int), 40)").alias("new"))]
    return docs.withColumn("edits", F.when(F.col("text").isNotNull(), F.array(*change)))
