"""Licence detection by ordered signature rules.

A text becomes words in lower case joined by single blanks, so line breaks, comment signs and punctuation do not matter.
One Aho-Corasick pass finds the keywords that it holds; only their rules' regexes run. A detection gives way where it
lies inside one of the same or a higher priority, or overlaps one of a higher priority.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import clear
from .license_rules import KINDS, RULES

# Fixed values of the query: phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.6
#: ASCII bytes: letters in lower case, digits as they are, all others blank. Bytes of other characters belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    regex: str


def read_rules(text: str = RULES) -> list[Rule]:
    """Rules of a table as in license_rules; each id also stands for a tag rule and a metadata rule."""
    out, label = [], ""
    for line in filter(None, map(str.strip, text.splitlines())):
        head = re.fullmatch(r"([^ ]+) = (.+)", line)
        if head:
            label, words = head.groups()
            out.append(Rule(label, *KINDS["I"], "spdx license identifier", rf"spdx license identifier(?: [^ ]+){{0,8}}? (?P<at>{words})"))
            if label not in ("public-domain", "proprietary"):
                out.append(Rule(label, *KINDS["C"], f"license {words}", f"license (?P<at>{words})"))
            continue
        kind, pattern = line[0], line[2:]
        keyword = re.search(r"(?<!\?P)<([^>]*)>", pattern)
        out.append(Rule(label, *KINDS[kind], keyword[1], pattern[:keyword.start()] + keyword[1] + pattern[keyword.end():]))
    return out


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def resolve(found: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Detections (start, end, label, priority, confidence) that stay, in order. Of equal intervals and priorities the smaller label does."""
    kept, covered = [], []
    for level in sorted({d[3] for d in found}, reverse=True):
        starts, reach, here = [s for s, _ in covered], -1, []
        for d in sorted((d for d in found if d[3] == level), key=lambda d: (d[0], -d[1], d[2])):
            before = bisect_right(starts, d[1] - 1) - 1
            if d[1] > reach and not (before >= 0 and covered[before][1] > d[0]):
                here.append(d)
                reach = d[1]
        kept += here
        merged = []
        for s, e in sorted([*covered, *((d[0], d[1]) for d in here)]):
            if merged and s < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        covered = merged
    return sorted(kept)


class Scanner:
    """Rules with their keyword automaton; built in each task."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(f"(?<= )(?:{r.regex})(?= )")) for r in rules]
        self.base = [(phrase, re.compile(f"(?<= ){phrase}(?= )")) for phrase in BASE]
        self.keywords = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            by_keyword.setdefault(r.keyword, []).append(i)
        for phrase in BASE:
            by_keyword.setdefault(phrase, [])
        for keyword, numbers in by_keyword.items():
            self.keywords.add_word(keyword, (keyword, numbers))
        self.keywords.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int, float]]]:
        """Number of words, places of base phrases as (word, label), and all detections that stay as word intervals."""
        words = words_of(text)
        # One character a byte: offsets agree, and rules only name ASCII characters.
        line = f" {b' '.join(words).decode('latin-1')} "
        hits = {value[0]: value[1] for _, value in self.keywords.iter(line)}
        if not hits:
            return len(words), [], []
        starts = list(accumulate((len(w) + 1 for w in words), initial=1))
        at = lambda position: bisect_right(starts, position) - 1
        base = [(at(m.start()), BASE[phrase]) for phrase, pattern in self.base if phrase in hits for m in pattern.finditer(line)]
        found = []
        for number in sorted(n for numbers in hits.values() for n in numbers):
            rule, pattern = self.rules[number]
            for m in pattern.finditer(line):
                start, end = m.span("at") if "at" in pattern.groupindex else m.span()
                found.append((at(start), at(end - 1) + 1, rule.label, rule.priority, rule.confidence))
        return len(words), sorted(base), resolve(found)


def certainty(base_labels: set[str], kept: list) -> float:
    """1 less the chance that every label's best detection errs; 0 without any."""
    best = dict.fromkeys(base_labels, BASE_CONFIDENCE)
    for _, _, label, _, confidence in kept:
        best[label] = max(best.get(label, 0.0), confidence)
    wrong = 1.0
    for label in sorted(best):
        wrong *= 1 - best[label]
    return 1 - wrong


def scan_licenses(docs: DataFrame, rules: str = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections for every row.

    `detections` lists what stays as structs (start, end, label, confidence) of word intervals, end exclusive. Null texts
    count as empty: no words, no labels, score 0. Texts are scanned whole, however long; repeated rows and ids are
    scanned each; other columns are not read. Labels are distinct and sorted, so ties do not matter.
    """
    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                  "detections array<struct<start: long, end: long, label: string, confidence: double>>")
    def scan(batches: pd.Series) -> pd.DataFrame:
        scanner, rows = Scanner(read_rules(rules)), []
        for text in batches:
            n, base, kept = scanner.scan(clear(text))
            labels = {label for _, label in base}
            rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
                         ",".join(sorted(labels | {d[2] for d in kept})), certainty(labels, kept),
                         [{"start": s, "end": e, "label": name, "confidence": c} for s, e, name, _, c in kept]))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan("text").alias("_s")).select("doc_id", "_s.*")
