"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is a BPE model with byte fallback. A segmentation is the model's own exactly when
every two neighbouring pieces stay as they are if their joint text is merged alone, so each prefix
of a text has one surviving best path: its last piece, and a pointer back. The search walks the
text once, keeps back pointers only for an open window, and commits ids up to the latest boundary
that all surviving paths (those of the last `longest` prefixes, which future pieces can start from)
share. No piece reaches across the front of a run of spaces, so paths always converge there, and
the ids of a word between two such boundaries are remembered, in two generations: when the newer
one is full it takes the place of the older, whose words are forgotten unless they were seen since.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import clear, send

SPACE = "▁"
WORD = re.compile(" *[^ ]+| +")
#: Where the vocabulary keeps Latin letters apart from other characters, paths also converge between them.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
RUN = re.compile(f" *(?:[{LATIN}]+|[^{LATIN} ]+)| +")
MIXED = re.compile(f"[{LATIN}][^{LATIN}]|[^{LATIN} ][{LATIN}]")
#: Open prefixes after which paths are compared, and words remembered in each of the two generations of a task.
OPEN, REMEMBERED = 256, 150_000
#: Rows handed back at once.
ROWS = 500
#: Merges that never come, and the cost from which a piece was added without a rank of its own.
NEVER, ADDED = float("inf"), 1e8


@dataclass
class PieceModel:
    """Plain tables of a vocabulary: `prefixes` has every prefix of a normal piece, with its id or -1."""

    prefixes: dict
    scores: list
    texts: list
    byte_ids: list
    longest: int
    letters_apart: bool = True          # no piece has a Latin letter next to another character, a space in front aside
    pairs: dict = field(default_factory=dict)
    spines: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)

    def merged(self, text: str) -> list[str]:
        """Merges of one short text, best score first, then leftmost."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                at = self.prefixes.get(parts[k] + parts[k + 1], -1)
                if at >= 0 and (best is None or self.scores[at] > best[0]):
                    best = (self.scores[at], k)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def edges(self, piece: str) -> tuple[list, list] | None:
        """The symbols at the left and at the right end of a piece while it is merged: (symbol, made at, used up at).

        None if its merges are not in the order of their ranks (pieces added with one common score).
        """
        if piece in self.spines:
            return self.spines[piece]
        steps, parts = [], list(piece)
        while len(parts) > 1:
            ranked = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.prefixes.get(parts[k] + parts[k + 1], -1)) >= 0]
            rank, k = min(ranked) if ranked else (NEVER, 0)
            if steps and rank < steps[-1][0] or rank >= ADDED:
                self.spines[piece] = None
                return None
            steps.append((rank, k, len(parts)))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        left, right = [[piece[0], -1.0, NEVER]], [[piece[-1], -1.0, NEVER]]
        for rank, k, n in steps:
            if k == 0:
                left[-1][2] = rank
                left.append([None, rank, NEVER])
            if k == n - 2:
                right[-1][2] = rank
                right.append([None, rank, NEVER])
        parts = list(piece)
        at = [0, 0]
        for rank, k, n in steps:
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if k == 0:
                at[0] += 1
                left[at[0]][0] = parts[0]
            if k == n - 2:
                at[1] += 1
                right[at[1]][0] = parts[-1]
        self.spines[piece] = left, right
        return self.spines[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart when their joint text is merged: no merge across comes before both its parts are used up."""
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return self.merged(left + right) == [left, right]
        get, scores = self.prefixes.get, self.scores
        for x, made, used in a[1]:
            for y, made_y, used_y in b[0]:
                i = get(x + y, -1)
                if i >= 0:
                    at = max(-scores[i], made, made_y)
                    if at < used and at <= used_y:
                        return False
        return True

    def segment(self, text: str) -> list[str]:
        """Pieces of one text in which ordinary spaces are already escaped."""
        if len(text) <= OPEN:
            return self.segment_short(text)
        committed, base, n = [], 0, len(text)       # committed: pieces of text[:base]
        last, came = {0: ""}, {}                    # of each prefix in the open window: its last piece, and where that starts
        get, pairs, longest = self.prefixes.get, self.pairs, self.longest
        for at in range(n):
            left = last[at]
            near = pairs.get(left)
            if near is None:
                near = pairs[left] = {}
            for end in range(at + 1, min(n, at + longest) + 1):
                piece = text[at:end]
                found = get(piece)
                if found is None and end > at + 1:
                    break
                if (end == at + 1 or found >= 0) and end not in last:
                    good = near.get(piece)
                    if good is None:
                        good = near[piece] = not left or self.apart(left, piece)
                    if good:
                        last[end], came[end] = piece, at
                if found is None:
                    break
            if at - base >= OPEN and at % (OPEN // 4) == 0:
                base = self.commit(last, came, base, at, committed)
        tail, at = [], n
        while at > base:
            tail.append(last[at])
            at = came[at]
        return committed + tail[::-1]

    def segment_short(self, text: str) -> list[str]:
        """The same search over a text whose prefixes all fit the open window."""
        n = len(text)
        last, came = [None] * (n + 1), [0] * (n + 1)
        last[0] = ""
        get, pairs = self.prefixes.get, self.pairs
        for at in range(n):
            left = last[at]
            near = pairs.get(left)
            if near is None:
                near = pairs[left] = {}
            piece, end = text[at], at + 1
            if last[end] is None:
                good = near.get(piece)
                if good is None:
                    good = near[piece] = not left or self.apart(left, piece)
                if good:
                    last[end], came[end] = piece, at
            if get(piece) is None:
                continue
            for end in range(at + 2, n + 1):
                piece = text[at:end]
                found = get(piece)
                if found is None:
                    break
                if found >= 0 and last[end] is None:
                    good = near.get(piece)
                    if good is None:
                        good = near[piece] = not left or self.apart(left, piece)
                    if good:
                        last[end], came[end] = piece, at
        tail, at = [], n
        while at:
            tail.append(last[at])
            at = came[at]
        return tail[::-1]

    def commit(self, last: dict, came: dict, base: int, at: int, committed: list) -> int:
        """Move what all surviving paths share to `committed`; the new start of the open window."""
        common = None
        for end in range(max(base + 1, at - self.longest + 1), at + self.longest + 1):
            if end in last:
                path = []
                while end > base:
                    path.append(end)
                    end = came[end]
                path.reverse()
                same = min(len(path), len(path) if common is None else len(common))
                if common is not None:
                    same = next((k for k in range(same) if path[k] != common[k]), same)
                common = path[:same]
        if not common:
            return base
        committed += [last[end] for end in common]
        for end in [e for e in last if e < common[-1]]:
            del last[end]
            came.pop(end, None)
        return common[-1]

    def ids(self, word: str) -> list[int]:
        """Ids of one word with the spaces before it."""
        known = self.words.get(word)
        if known is None:
            known = self.older.get(word)
            if known is None:
                known = []
                for piece in self.segment(word.replace(" ", SPACE)):
                    at = self.prefixes.get(piece, -1)
                    if at >= 0:
                        known.append(at)
                    else:
                        known += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            if len(word) <= 64:
                if len(self.words) >= REMEMBERED:
                    self.older.clear()
                    self.older.update(self.words)
                    self.words.clear()
                self.words[word] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; empty for an empty text."""
        out, get = [], self.words.get
        if text:
            for word in (RUN if self.letters_apart else WORD).findall(" " + text):
                out += get(word) or self.ids(word)
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        out, raw = [], bytearray()
        base, ids = self.byte_ids[0], np.asarray(ids)
        if not ((ids >= base + 128) & (ids < base + 256)).any():     # other bytes are letters of their own
            text = "".join(map(self.texts.__getitem__, ids.tolist())).replace(SPACE, " ")
            return text[1:] if text.startswith(" ") else text
        for i in ids.tolist():
            if base <= i < base + 256:
                raw.append(i - base)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.texts[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def load_pieces(path: str) -> PieceModel:
    """Read a vocabulary file; its path is on the driver, tasks get plain tables of the fixed vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    texts, prefixes, longest = [], {}, 1
    for i in range(size):
        text = model.id_to_piece(i)
        odd = model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        byte = int(text[1:-1], 16) if model.is_byte(i) else 256
        texts.append(chr(byte) if byte < 128 else "" if odd else text)
        if not odd:
            longest = max(longest, len(text))
            for k in range(1, len(text)):
                prefixes.setdefault(text[:k], -1)
            prefixes[text] = i
    return PieceModel(prefixes, [model.get_score(i) for i in range(size)], texts, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
                      longest, not any(MIXED.search(t.replace(SPACE, " ")) or " " in t.replace(SPACE, " ").lstrip(" ") for t in texts))


def encode_pieces(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, n_ids, ids, round_trip for every row, from whole texts; null texts have no ids and decode to the empty text.

    `round_trip` is false only where the text itself holds the space mark U+2581, which the vocabulary cannot tell from a space.
    """
    sent = send(docs.sparkSession, model)

    def encoded(batches):
        own = sent()
        for part in (pdf[k:k + ROWS] for pdf in batches for k in range(0, len(pdf), ROWS)):
            texts = [clear(t) for t in part["text"]]
            ids = [own.encode(t) for t in texts]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_ids": [len(i) for i in ids], "ids": ids,
                                "round_trip": [own.decode(i) == t for i, t in zip(ids, texts)]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(encoded, f"doc_id {kind}, n_ids long, ids array<int>, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: PieceModel, column: str = "ids") -> DataFrame:
    """`encoded` with a column `text` made from its ids; null ids give a null text."""
    sent = send(encoded.sparkSession, model)

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        own = sent()
        return pd.Series([None if i is None else own.decode(i) for i in ids], dtype=object)

    return encoded.withColumn("text", decoded(column))
