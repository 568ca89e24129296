"""Personal data: overlapping candidate spans, judged by boosted trees.

Four kinds of base spans (email, ip, card, phone) follow fixed patterns and always count. High-recall
generators propose further, overlapping spans: addresses with a spelled-out or bracketed at sign,
numbers with other separators, a missing country code or a bracketed area, also beside other numbers. Gradient-boosted trees
rate each proposal by its format and its context, without the features that define the base
patterns (leading plus, separator kind, at sign). They learn from the candidates of every document:
base spans against proposals that break a rule of their kind (Luhn, octets, length, domain). Spark
counts candidates of equal binned features, and the driver meets those counts only (at most
`max_cells`, with coarser bins where there are more). The threshold is the lowest score that keeps
the wanted precision on a fifth of the candidates kept back. A proposal that passes and overlaps no base span is added.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .base import clear, send

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Proposals: (kind, pattern). They overlap each other and the base spans.
AT_WORD = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}[ ]?(?:\(at\)|\[at\]|\{at\})[ ]?[\w-]{1,63}(?:(?:\.|[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?)[\w-]{1,63}){0,4}", re.I)
RUN = re.compile(r"(?<![\w.+(-])[(]?[0-9](?:[\x20()./-]{0,2}[0-9])*")
GROUP = re.compile(r"[0-9]+")
TORN = re.compile(r"[\w-]")
CONTEXT = {
    "email": re.compile(r"mail|contact|write|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|ping", re.I),
    "card": re.compile(r"card|visa|credit|account|pay|iban", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|cell", re.I),
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Matches of the address pattern, leftmost and not overlapping, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        reach = 64
        while True:  # the run of local characters that ends at the sign
            low = max(free, at - reach)
            run = LOCAL.match(text[low:at][::-1])
            if not run or low == free or run.end() < at - low:
                break
            reach *= 4
        if run and (domain := DOMAIN.match(text, at + 1)):
            yield at - run.end(), domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed; matches that fail their rule are dropped without another try."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if len(m.group()) <= 40 and 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates of the generators: in a run of digits, neighbouring groups with 9 to 19 digits
    for each kind they could be, and each dotted quad. A group has few such windows, so the time is linear."""
    found = [("email", m.start(), m.end()) for m in AT_WORD.finditer(text)] if re.search(r"[(\[{]at[)\]}]", text, re.I) else []
    for m in RUN.finditer(text) if DIGIT.search(text) else ():
        groups = [g.span() for g in GROUP.finditer(text, m.start(), m.end())]
        if TORN.match(text, m.end()):
            groups.pop()
        for k, (start, _) in enumerate(groups):
            quad = groups[k:k + 4]
            if len(quad) == 4 and text[start:quad[3][1]].count(".") == 3 and all(text[e:s] == "." for (_, e), (s, _) in zip(quad, quad[1:])) \
                    and sum(e - s for s, e in quad) <= 20:
                found.append(("ip", start, quad[3][1]))
            n, low = 0, start - (start > m.start() and text[start - 1] == "(")
            for s, e in groups[k:k + 19]:
                n += e - s
                if n > 19:
                    break
                if n >= 12:
                    found.append(("card", low, e))
                if 9 <= n <= 15:
                    found.append(("phone", low, e))
    return found


def valid(kind: str, span: str) -> bool:
    """Whether a span keeps its kind's rule, whatever its separators."""
    digits = "".join(c for c in span if c.isdigit())
    if kind == "email":
        return bool(re.search(r"(\.|dot)[)\]} ]*[A-Za-z]{2,}$", span, re.I))
    if kind == "ip":
        return all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in span.split("."))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15 and len(re.findall("[0-9]+", span)) >= 3


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one span."""
    span, before, after = text[start:end], text[max(0, start - 32):start], text[end:end + 8]
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    digits = sum(groups)
    return [KINDS.index(kind), len(span), digits, digits / len(span), len(groups), max(groups), min(groups), groups[0], groups[-1],
            float(len(set(groups)) == 1), float(luhn("".join(re.findall("[0-9]", span)))) if digits else -1.0,
            float(bool(CONTEXT[kind].search(before))), float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after),
            float(after[:1] in ".,;)"), sum(c.isalpha() for c in span), sum(c.isupper() for c in span), sum(c.isdigit() for c in before),
            sum(c.isdigit() for c in after)]


@dataclass
class BoostedTrees:
    """Additive depth-limited trees for the logistic loss: nodes are (feature, cut, left, right, value)."""

    bias: float
    trees: list
    threshold: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(8):
                feature, cut, left, right, _ = (c[at] for c in tree)
                inner = feature >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature, 0)] <= cut
                at = np.where(inner, np.where(go, left, right), at)
            out += tree[4][at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, step: float = 0.3, bins: int = 32,
          weight: np.ndarray | None = None, cuts: list[np.ndarray] | None = None) -> BoostedTrees:
    """Histogram gradient boosting with second-order leaf values; a row stands for `weight` equal ones, `cuts` may be given."""
    weight = np.ones(len(y)) if weight is None else weight
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model = BoostedTrees(float(np.log(share / (1 - share))), [])
    cuts = cuts or [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    raw = np.full(len(y), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        nodes, stack = [[-1, 0.0, 0, 0, 0.0]], [(0, np.arange(len(y)), 0)]
        while stack:
            node, rows, level = stack.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes[node][4] = -step * gs / (hs + 1)
            best = (1e-6, None, None)
            for f in range(x.shape[1]) if level < depth and weight[rows].sum() > 20 else ():
                if len(cuts[f]):
                    at = np.searchsorted(cuts[f], x[rows, f])
                    gl, hl = (np.cumsum(np.bincount(at, v[rows], len(cuts[f]) + 1))[:-1] for v in (g, h))
                    gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, float(cuts[f][k]))
            if best[1] is not None:
                go = x[rows, best[1]] <= best[2]
                if go.any() and not go.all():
                    nodes[node][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
                    nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                    stack += [(nodes[node][2], rows[go], level + 1), (nodes[node][3], rows[~go], level + 1)]
        tree = tuple(np.array([n[k] for n in nodes], float if k in (1, 4) else np.int64) for k in range(5))
        inner = tree[0] >= 0
        tree[4][inner] = 0.0
        model.trees.append(tree)
        raw += BoostedTrees(0.0, [tree]).raw(x)
    return model


def candidate_counts(docs: DataFrame) -> DataFrame:
    """Features `x` and label `y` of the candidates of all documents, with the number `n` of each."""
    def candidates(batches):
        for pdf in batches:
            counts = Counter()
            for text in map(clear, pdf["text"]):
                base = base_spans(text)
                taken = set(base)
                counts.update((tuple(describe(text, *b)), 1.0) for b in base)
                counts.update((tuple(describe(text, *c)), 0.0) for c in proposals(text) if c not in taken and not valid(c[0], text[c[1]:c[2]]))
            yield pd.DataFrame({"x": [list(map(float, k[0])) for k in counts], "y": [k[1] for k in counts], "n": list(counts.values())})

    return docs.select("text").mapInPandas(candidates, "x array<double>, y double, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))


def binned_counts(counts: DataFrame, cuts: list[np.ndarray], max_cells: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Counts by the number of cuts below each feature, and the cuts; every second cut is left out until `max_cells` hold all."""
    def lower(f: int, own: np.ndarray) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in own]), lambda c: c < F.col("x")[f])) if len(own) else F.lit(0)
    below = F.array(*[lower(f, own) for f, own in enumerate(cuts)])
    cells = materialise(counts.groupBy(below.alias("bins"), "y").agg(F.sum("n").alias("n")), "pii-cells")
    while cells.count() > max_cells and any(map(len, cuts)):
        cuts = [own[1::2] for own in cuts]
        cells = materialise(cells.groupBy(F.transform("bins", lambda k: F.floor(k / 2).cast("int")).alias("bins"), "y").agg(F.sum("n").alias("n")), "pii-cells")
    return cells, cuts


def fit(docs: DataFrame, max_cells: int = 100_000, precision: float = 0.99, bins: int = 32) -> BoostedTrees:
    """Learn from the candidates of all documents."""
    counts = materialise(candidate_counts(docs), "pii-candidates")
    if counts.select("y").distinct().count() < 2:
        return BoostedTrees(0.0, [], 2.0)
    at = [float(q) for q in np.linspace(0, 1, bins + 1)[1:-1]]
    width = len(describe("1", "ip", 0, 1))
    quantiles = counts.agg(*[F.percentile_approx(F.col("x")[f], at, 1000).alias(f"q{f}") for f in range(width)]).first()
    cells, cuts = binned_counts(counts, [np.unique(quantiles[f"q{f}"]) for f in range(width)], max_cells)
    got = cells.orderBy(F.hash("bins"), "y", "bins").toPandas()
    edges = [np.append(own, np.inf) for own in cuts]
    places = np.array(got["bins"].tolist(), np.int64)
    x, y, n = np.column_stack([own[places[:, f]] for f, own in enumerate(edges)]), got["y"].to_numpy(), got["n"].to_numpy()
    upto = np.cumsum(n)
    back = -(-upto // 5) + (-(upto - n) // 5)  # every fifth candidate
    front = n > back
    model = boost(x[front], y[front], weight=(n - back)[front].astype(float), cuts=cuts)
    kept = back > 0
    p, t, w = model.probability(x[kept]), y[kept], back[kept]
    down = np.argsort(-p, kind="stable")
    p, t, w = p[down], t[down], w[down]
    right = np.cumsum(t * w) / np.cumsum(w)
    enough = np.flatnonzero((right >= precision) & np.append(p[1:] != p[:-1], True))
    model.threshold = max(0.9, float(p[enough[-1]])) if len(enough) else 2.0
    return model


def torn(text: str, start: int, end: int) -> int:
    """How many ends of a span cut a number: a separator without space joins them to more digits."""
    return bool(re.search(r"[0-9][./-]$", text[max(0, start - 2):start])) + bool(re.match(r"[./-][0-9]", text[end:end + 2]))


def spans_of(text: str, model: BoostedTrees) -> tuple[list, list]:
    """(base spans, all spans): proposals that keep their rule, reach the threshold and touch no other span are added,
    those that cut the fewest numbers first, then by score."""
    base = base_spans(text)
    open_ = [c for c in proposals(text) if valid(c[0], text[c[1]:c[2]]) and c not in base]
    kept = list(base)
    if open_ and model.trees:
        p = model.probability(np.array([describe(text, *c) for c in open_]))
        for score, c in sorted(zip(-p, open_), key=lambda z: (torn(text, *z[1][1:]), z[0], z[1][1], KINDS.index(z[1][0]))):
            if -score >= model.threshold and all(c[2] <= s or e <= c[1] for _, s, e in kept):
                kept.append(c)
    return base, sorted(kept, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, model: BoostedTrees | None = None, **fitting) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, their digest, all spans, and the number of added ones.

    Null texts count as empty and have no span. Repeated rows are judged each; other columns are not read.
    """
    sent = send(docs.sparkSession, model or fit(docs, **fitting))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def found(texts: pd.Series) -> pd.DataFrame:
        own, rows = sent(), []
        for text in map(clear, texts):
            base, every = spans_of(text, own)
            rows.append([*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every),
                         len(every) - len(base)])
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", found("text").alias("_f")).select("doc_id", "_f.*")


def redact(docs: DataFrame, model: BoostedTrees | None = None, **fitting) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets and `n_chars` counted anew; overlapping spans merge under the first kind."""
    sent = send(docs.sparkSession, model or fit(docs, **fitting))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        own, out = sent(), []
        for text in texts:
            if not isinstance(text, str):
                out.append(None)
                continue
            parts, at = [], 0
            for kind, start, end in spans_of(text, own)[1]:
                if start >= at:
                    parts += [text[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean("text")).withColumn("n_chars", F.length("text").cast("long"))
