"""Whitening, fill-in-middle and licence scans against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from hearthframe.llm import infill, licenses, whitening
from hearthframe.llm.queries import ORACLES, QUERIES

EXTRA = "doc_id long, text string, n long, form string, score double, output string, rank int, `a.b` string, h1 long, x string"


def frame(spark, texts, ids=None):
    rows = [(i, t, 1, "f", 0.5, "o", 1, "d", 7, "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


# Fill-in-middle --------------------------------------------------------------------

def plain_infill(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_infill_equals_plain_cuts_and_restores(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "a", "<P>", "a<S", "<M", "P>", "<<P", "x<M>y", "$1 \\2 {3}", "é ü 漢字 😀😀 ab", "\r\n\x00 ", "ab" * 50]
    texts += ["".join(rng.choice(["word", "A", " ", "\n", "<", ">", "P", "S>", "<M", "7", "é", "😀", "$", "\\"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["long text, " * 200_000, "\n" * 300_000, "z" * 1_000_000]
    ids = [*range(len(texts) - 3), None, 10 ** 15, 5]
    got = sorted(map(tuple, infill.fill_in_middle(frame(spark, texts, ids)).collect()), key=repr)
    assert got == sorted(((i, *plain_infill(i, t)) for i, t in zip(ids, texts)), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infill_of_nothing_and_without_python(spark):
    out = infill.fill_in_middle(frame(spark, []))
    assert out.collect() == [] and "Python" not in out._jdf.queryExecution().toString() and "Exchange" not in infill.fill_in_middle(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()


def test_infill_query_equals_its_sql(spark):
    from compare import compare, duck
    sf = "/root/testdata/sf0.001"
    found = compare(spark, duck(sf), "op12", QUERIES["op12_fill_in_middle"], ORACLES["op12_fill_in_middle"], sf)
    assert found["status"] == "ok", found


# Licences --------------------------------------------------------------------------

def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_scan_equals_plain_base_and_keeps_its_labels(spark):
    rng = random.Random(5)
    bits = ["GNU", "General", "Public", "License", "apache", "APACHE License", "cc-by", "CC BY-SA 4.0", "MIT License", "mit", "license", "émit", " ", "and", "- ", "\n// "]
    texts = [None, "", "  ", "a", "mit license", "MIT_LICENSE", "mitlicense", "mit license", "gnu\x00general*public\nlicense", "K cc by"]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    texts += ["filler words, " * 150_000 + "Released under the MIT License. " + "more " * 100_000, "mit license " * 20_000]
    ids = [*range(len(texts) - 1), 4]
    rows = licenses.scan_licenses(frame(spark, texts, ids)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert got == sorted(((i, *plain_scan(t)) for i, t in zip(ids, texts)), key=repr)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert licenses.scan_licenses(frame(spark, [])).collect() == []


@pytest.mark.parametrize("text,labels", [
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2.0-or-later,gpl-with-classpath-exception"),
    ("Licensed under the Apache License,\n * Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache,apache-2.0"),
    ('{"license": "GPL-3.0-or-later"}', "gpl-3.0-or-later"),
    ("License :: OSI Approved :: MIT License", "mit"),
    ("This library is under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/legalcode", "cc-by-nc-sa-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("You must obtain a driving licence.", ""),
    ("limits and permits", ""),
])
def test_signatures(text, labels):
    _, base, kept = licenses.Scanner(licenses.read_rules()).scan(text)
    assert ",".join(sorted({x for _, x in base} | {d[2] for d in kept})) == labels


def test_every_rule_is_gated_by_a_word_that_its_matches_contain():
    from re import _parser as sre_parse

    def needed(tree):
        """Literal text that every match of a regex holds, runs of it apart by newlines."""
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "SUBPATTERN":
                out += needed(arg[-1])
            else:
                out += "\n"
        return out
    rules = licenses.read_rules()
    assert len(rules) > 300
    for rule in rules:
        assert rule.keyword in needed(sre_parse.parse(rule.regex)), rule


def test_overlaps_are_resolved_like_a_plain_version():
    rng = random.Random(9)
    for _ in range(300):
        found = [(s, s + rng.randint(1, 6), rng.choice("abc"), rng.randint(1, 3), 0.5) for s in (rng.randint(0, 12) for _ in range(rng.randint(0, 9)))]
        kept = []
        for d in sorted(found, key=lambda d: (-d[3], d[0], -d[1], d[2])):
            inside = any(k[3] == d[3] and k[0] <= d[0] and d[1] <= k[1] for k in kept)
            if not inside and not any(k[3] > d[3] and k[0] < d[1] and d[0] < k[1] for k in kept):
                kept.append(d)
        assert licenses.resolve(found) == sorted(kept)


# Whitening -------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component int, n long, x string, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS).repartition(4)


def plain_whitening(rows, k):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    n, m = len(kept), np.array([v for _, v in kept], object)
    gap = m * n - m.sum(axis=0)
    c = gap.astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [i for i, _ in kept], n, [int(s) for s in (gap * gap).sum(axis=1)], c @ v / np.sqrt(e), e / (c ** 2).sum() * n


@pytest.mark.parametrize("d,k", [(40, 8), (6, 32), (70, 32)])
def test_whitening_equals_a_full_decomposition(spark, d, k):
    rng = np.random.default_rng(d)
    basis = rng.standard_normal((d, d)) * np.linspace(3, 0.3, d)
    rows = [(i, [float(x) for x in (rng.standard_normal(d) @ basis + 2).astype(np.float32)]) for i in range(400)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (900, None), (901, []), (902, [None] * d), (903, [math.nan] * d), (904, [math.inf] + [0.0] * (d - 1))]
    got = whitening.whiten(vectors(spark, rows), k).toPandas()
    ids, n, deviation, white, explained = plain_whitening(rows, k)
    k = min(k, d)
    assert len(got) == n * k and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    by_vector = sorted((repr(None if math.isnan(i) else int(i)), int(dev), sorted(zip(g["component"], g["whitened"].abs().round(6), g["explained"].round(9))))
                       for (i, dev, _), g in got.assign(row=got.index // k).groupby(["vec_id", "deviation", "row"], dropna=False))
    want = sorted((repr(i), dev, sorted(zip(range(1, k + 1), np.abs(w).round(6), explained.round(9)))) for i, dev, w in zip(ids, deviation, white))
    assert [(a, b) for a, b, _ in by_vector] == [(a, b) for a, b, _ in want]
    assert np.allclose([[t[1:] for t in x[2]] for x in by_vector], [[t[1:] for t in x[2]] for x in want], atol=2e-6)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [math.nan])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and abs(line[0].explained - 1) < 1e-9
    with pytest.raises(Exception, match="length"):
        whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0])])).collect()


def test_filter_damps_and_raises():
    values = np.array([5.0, 2.0, 1.0, 0.5, 0.0])
    v = np.diag(values)
    q = np.eye(5)
    out = whitening.filtered(q, v @ q, lambda y: v @ y, 8, 0.0, 1.0, 5.0)
    # Chebyshev polynomials in their closed form, scaled to 1 at the top value.
    at = lambda x: np.cosh(8 * np.arccosh(x)) if x > 1 else np.cos(8 * np.arccos(x))
    assert np.allclose(np.diag(out), [at(2 * x - 1) / at(9.0) for x in values])


# Registered queries ------------------------------------------------------------------

@pytest.mark.parametrize("name,rows", [("op11_whitening", 500 * 32), ("op13_license_scan", 200)])
def test_registered_queries_return_their_contract(spark, name, rows):
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = {"op11_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            "op13_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]}[name]
    assert out.columns[:len(want)] == want and out.count() == rows
