"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.llm import base, decontaminate, edits, hamming, language, minmax, pieces, pii, suffixes, toxicity, weighting
from hearthframe.llm.queries import ORACLES, QUERIES, TOKENIZERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join("w%d" % min(int(rng.paretovariate(0.6)), words) for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", " \n\t", "a", "A b", "é ü ñ", "x" * 5000, "ab " * 4000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = list(ODD)
    for g in range(12):
        first = prose(g, 120).split()
        out.append(" ".join(first))
        for _ in range(rng.randint(0, 4)):
            edited = list(first)
            for _ in range(rng.randint(0, 16)):
                edited[rng.randrange(len(edited))] = "n%d" % rng.randint(0, 10 ** 6)
            out.append(" ".join(edited))
    passage = "this passage of more than one hundred bytes turns up in many documents, word for word, again and again, without a change"
    out += [f"{prose(50 + i, 20)} {passage} {prose(80 + i, 15)}" for i in range(12)]
    return out


def test_suffixes_equal_all_windows(spark, texts, monkeypatch):
    docs = frame(spark, texts)
    seen, want = set(), {}
    for d, t in enumerate(texts):
        body = (t or "").encode()
        mask = np.zeros(len(body) + 2, bool)
        for i in range(len(body) - 99):
            if body[i:i + 100] in seen:
                mask[i + 1:i + 101] = True
            seen.add(body[i:i + 100])
        edge = np.flatnonzero(np.diff(mask.astype(int)))
        want[d] = (len(body), int(mask.sum()), len(edge) // 2, hashlib.sha256(np.frombuffer(body, np.uint8)[~mask[1:-1]].tobytes()).hexdigest())
    for batches, crowded in ((1, 4096), (5, 4096), (2, 1)):
        monkeypatch.setattr(suffixes, "CROWDED", crowded)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, batches=batches).collect()}
        assert got == want
    assert suffixes.remove_repeats(docs.where("doc_id < 0")).count() == 0


def test_suffix_levels_merge_geometrically(spark):
    family = suffixes.SuffixFamily()
    for k in range(5):
        family.add(frame(spark, [prose(k, 60)], [k]))
    assert [rank for rank, _ in family.levels] == [4, 1]


def test_pieces_equal_the_library_and_round_trip(spark, texts):
    import sentencepiece
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    model, library = pieces.load_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    more = ["".join(rng.choice("ab  \n<s>é漢😀.'1") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    more += ["a" * 3000, "ab" * 2000 + " " * 50 + "<unk>", "".join(rng.choice("theingon") for _ in range(4000))]
    for text in [t or "" for t in texts] + more:
        ids = model.encode(text).tolist()
        assert ids == library.encode(text)
        assert model.decode(ids) == text
    got = pieces.encode_pieces(frame(spark, texts), model)
    assert all(r.round_trip and list(r.ids) == library.encode(texts[r.doc_id] or "") for r in got.collect())
    assert {r.doc_id: r.text for r in pieces.decode_pieces(got, model).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_streaming_window_stays_bounded():
    model = pieces.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    most, commit = [0], model.commit

    def watched(last, came, start, at, committed):
        most[0] = max(most[0], len(last))
        return commit(last, came, start, at, committed)
    model.commit = watched
    text = "".join(random.Random(1).choice("theingonra") for _ in range(20_000))
    assert "".join(model.segment(text)) == text
    assert 0 < most[0] <= 2 * pieces.OPEN + model.longest


def test_weighting_base_and_normalisation(spark, texts):
    docs = frame(spark, texts, [7 * i for i in range(len(texts))])
    ids = {7 * i: t for i, t in enumerate(texts)}
    tokens = {d: [*WORD.findall(low(t)), None] for d, t in ids.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in ids}
    count = Counter(w for d in ids if not held[d] for w in tokens[d])
    total, types = sum(count.values()), len(count)
    rows = weighting.score_texts(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), total)
        assert r.n_known == sum(count[w] > 0 for w in tokens[r.doc_id]) and abs(r.base_score - want) < 1e-6
        assert r.score <= 0 and math.isfinite(r.score)
    assert weighting.score_texts(docs.where("doc_id < 0")).count() == 0


def test_tree_weights_are_distributions_and_match_plain_recursion():
    rng = np.random.default_rng(3)
    counts = np.zeros((1 << 16, 256))
    at = rng.integers(0, 1 << 16, 300)
    counts[at, rng.integers(97, 110, 300)] += rng.integers(1, 9, 300)
    log = weighting.tree_weights(counts)
    assert np.allclose((10.0 ** log[at[:20]].astype(float)).sum(axis=1), 1, atol=1e-4)
    # One decision node (the first bit), by the definition: log weighted probability and prediction down one path.
    shape = counts.reshape(64, 32, 32, 256)

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def walk(level, index):
        c = shape[index[:level]].reshape(-1, 256).sum(axis=0)
        a, b = c[:128].sum(), c[128:].sum()
        own, p = kt(a, b), (b + .5) / (a + b + 1)
        if level == 3:
            return own, p
        children = sum(walk(level + 1, (*index[:level], k, *([0] * (2 - level))))[0] for k in range(shape.shape[level]))
        whole = np.logaddexp(own, children) - math.log(2)
        share = math.exp(own - math.log(2) - whole)
        deeper = walk(level + 1, index)[1]
        return whole, share * p + (1 - share) * deeper
    path = np.unravel_index(at[0], (64, 32, 32))
    want = walk(0, tuple(int(x) for x in path))[1]
    assert abs((10.0 ** log[at[0], 128:].astype(float)).sum() - want) < 1e-4


def test_edits_equal_a_full_recount(spark, texts):
    ranks = edits.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    counter, rng = edits.Counter(ranks), random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("ab  \n\t'slvre1.,é") for _ in range(rng.randint(0, 900)))
        tree = edits.TokenTree(*counter.leaves(text))
        for _ in range(4):
            start = rng.randint(0, len(text))
            end = min(len(text), start + rng.choice([0, 0, 1, 3, 30, 400]))
            new = "".join(rng.choice("ab  \n'slvre1.") for _ in range(rng.choice([0, 1, 2, 5, 400])))
            text, _ = tree.edit(text, start, end, new, counter)
            lengths, counts = counter.leaves(text)
            assert [x for b in tree.blocks for x in b[0]] == lengths
            assert (tree.tokens, tree.characters) == (sum(counts), len(text))
    rows = edits.count_through_edits(edits.own_edits(frame(spark, texts)), ranks).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(counter.encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    long = [r for r in rows if r.n_pretokens > 1000]
    assert long and all(r.n_encoded_again < 60 for r in long)


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_spans_and_redaction(spark):
    rng = random.Random(9)
    found = ["".join(rng.choice("a@.1 2+-(9)%_é\n0") for _ in range(rng.randint(0, 70))) for _ in range(3000)]
    found += ["1" * 4000 + ".1.1.1", "a" * 5000 + "@b.c", "+1" + " " * 4000 + "2", "4111 1111 1111 1111 x", "mail me: a.b@c-d.example.org."]
    for text in found:
        assert pii.base_spans(text) == plain_spans(text)
    docs = frame(spark, [*ODD, *found[-5:], "call +44 20 7946 0958 now", "call +44 20 7946 0958 now"])
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for d, text in {r.doc_id: r.text for r in docs.collect()}.items():
        want = plain_spans(text or "")
        assert rows[d].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(filter(None, pii.joined(want).split(","))) <= set(rows[d].spans.split(","))
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[len(ODD) + 5].text == "call [PHONE] now" and clean[0].text is None and clean[3].text == "a"
    assert pii.find_pii(docs.where("doc_id < 0")).count() == 0


def test_boosting_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > .5) & (x[:, 2] < .3)).astype(float)
    model = pii.boost(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > .5) == y[1500:]).mean() > .97


def test_language_held_out_accuracy(spark):
    rng = random.Random(3)
    alphabet = {"aa": "abcde fgh", "bb": "nopq rstu", "cc": "éèêß üöä"}
    rows = [(i, "".join(rng.choice(alphabet[k]) for _ in range(80)), k, "s", 80) for i, k in enumerate(rng.choices(list(alphabet), k=300))]
    rows += [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "12 34!", "bb", "s", 6), (1003, "abc " * 3000, None, "s", 9)]
    got = {r.doc_id: r for r in language.identify_language(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert len(got) == len(rows) and np.mean([got[r[0]].lang_pred == r[2] for r in held]) > .97
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify_language(empty).count() == 0


def test_toxicity_separates_and_takes_odd_rows(spark):
    bad, rng, rows, labels = ["awful", "scum", "vile"], random.Random(8), [], []
    for i in range(700):
        words = prose(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "vile " * 20_000, "en", "s", 0)]
    labels += [(2000, None, None), (None, 1, 1), (3, 0, None), (999_999, 1, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    held = [i for i in range(700) if got[i].held_out]
    assert len(got) == len(rows) and np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > .95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got.values()) and got[2002].predicted == 1
    assert all(r.score < 1e-9 for r in toxicity.toxicity_scores(docs.limit(5), marks.where("false")).collect())


def linked(sets, percent=80):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_minmax_components_equal_all_pairs(spark, texts, words):
    tokens = {d: WORD.findall(low(t)) for d, t in enumerate(texts)}
    sets = {d: {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for d, w in tokens.items()}
    want = linked(sets)
    got = {r.doc_id: r for r in minmax.near_duplicates(frame(spark, texts), words=words).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


def test_minmax_chains_and_odd_rows(spark):
    first = [f"t{i}" for i in range(100)]
    chain = [" ".join(f"c{k}-{i}" if i < 4 * k else w for i, w in enumerate(first)) for k in range(12)]
    rows = frame(spark, [*chain, None, "x", "x"], [*range(20, 32), 1, 2, None])
    got = minmax.near_duplicates(rows, words=2).collect()
    tokens = {20 + k: c.split() for k, c in enumerate(chain)}
    want = linked({d: set(zip(w, w[1:])) for d, w in tokens.items()})
    assert {r.doc_id: r.component_id for r in got if r.doc_id and r.doc_id >= 20} == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minmax.near_duplicates(rows.where("doc_id < 0")).count() == 0


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(12)
    items = [prose(900 + i, rng.randint(12, 40), 3000).split() for i in range(8)] + [["only", "three", "words"]]
    docs = [None, "", "only three words", "ONLY three\twords"]
    for i in range(60):
        body, item = prose(i, rng.randint(5, 200), 3000).split(), list(rng.choice(items))
        if i % 2:
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(item))
                item[k:k + rng.randint(0, 1)] = [] if rng.random() < .5 else ["zz%d" % i]
            if i % 7 == 0:
                item = item[len(item) // 2:] + item[:len(item) // 2]
            at = rng.randrange(len(body))
            body[at:at] = item
        docs.append(" ".join(body))

    def bag(words):
        return [tuple(words[k:k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    want = {}
    for d, text in enumerate(docs):
        own = bag(WORD.findall((text or "").lower()))
        for i, item in enumerate(items):
            other = bag(item)
            w = min(len(own), len(other))
            for start in range(len(own) - w + 1) if own else ():
                both = sum((Counter(own[start:start + w]) & Counter(other)).values())
                share = both / (w + len(other) - both)
                if share >= .8 - 1e-12 and share > want.get((d, i), (0, 0))[0] + 1e-12:
                    want[d, i] = (share, start + 1)
    bench = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(items)] + [(50, None, "x"), (51, "", "x")], "item_id long, text string, lang string")
    rows = frame(spark, docs)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(rows, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want) and len(want) > 10
    kept = decontaminate.drop_contaminated(rows, bench)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert decontaminate.contaminated(rows, bench.where("false")).count() == 0 == decontaminate.contaminated(rows.where("false"), bench).count()


def test_decontamination_runs_no_python(spark):
    rows = frame(spark, ["a b c d e f"])
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = decontaminate.contaminated(rows, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hamming_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 70))
    vectors = [(centre[i % 6] + .4 * rng.normal(size=70)).tolist() for i in range(200)] + [centre[0].tolist()] * 40
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(900, None, 0), (None, vectors[0], 0), (901, [None, float("nan"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in hamming.nearest(df, df.where("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    bits = np.array(vectors) > 0
    for q in range(0, 240, 20):
        near = sorted(((bits[q] != bits).sum(axis=1)[i], i) for i in range(len(bits)))[:7]
        assert [(d, i) for _, d, i in sorted(got[q])] == near
    assert hamming.nearest(df.where("false"), df).count() == 0


def test_pipeline_stages_follow_their_operators(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(300):
        words = prose(i, 80, 5000).split()
        if i % 6 == 0:
            for _ in range(5):
                words[rng.randrange(80)] = rng.choice(["vile", "scum"])
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 6 == 0)))
    item = prose(777, 30, 5000)
    texts += [texts[1], texts[1] + " more", f"{prose(1000, 30)} {item} {prose(1001, 9)}", "write to a.b@example.org today please my friend"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns = base.table(spark, str(tmp_path), "documents"), SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert k == 4 or docs.columns == columns
    toxic = {i for i in range(0, 300, 6)}
    assert len(toxic - seen[0].keys()) > 45 and len(set(range(300)) - toxic - seen[0].keys()) < 5
    assert {300, 301} <= seen[0].keys() and not {300, 301} & seen[1].keys() and 1 in seen[1]
    assert seen[1].keys() - seen[2].keys() == {302}
    assert seen[3][303].text == "write to [EMAIL] today please my friend" and seen[3].keys() == seen[2].keys() == seen[4].keys()
    assert all(r.round_trip for r in seen[4].values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_deep_tree_matches_plain_recursion_and_learns_long_contexts(spark):
    texts = ["abcabd" * 3, "zabcab", "", "xabcaq", "abcabc"] * 2
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in weighting.score_texts(docs).collect()}
    train = [t.encode() + b"\xff" for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 10]
    seen = Counter((b"\xff" * 7 + t[:i])[-7:][::-1] + t[i:i + 1] for t in train for i in range(len(t)))

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def walk(context, depth, level, node, bit, follow):
        own = [sum(n for g, n in seen.items() if g[:depth] == context[:depth] and (256 | g[7]) >> (8 - level) == node and g[7] >> (7 - level) & 1 == v) for v in (0, 1)]
        if not sum(own):
            return 0.0, 0.5
        log, p = kt(*own), (own[bit] + .5) / (sum(own) + 1)
        if depth == 7:
            return log, p
        kids = {g[depth] for g in seen if g[:depth] == context[:depth]}
        below = sum(walk(context[:depth] + bytes([k]), depth + 1, level, node, bit, False)[0] for k in kids)
        whole = np.logaddexp(log, below) - math.log(2)
        share = math.exp(log - math.log(2) - whole)
        return whole, share * p + (1 - share) * walk(context, depth + 1, level, node, bit, True)[1] if follow else 0.0

    for d in (0, 1, 3):
        text, want = texts[d].encode() + b"\xff", 0.0
        for i, byte in enumerate(text):
            context = (b"\xff" * 7 + text[:i])[-7:][::-1]
            want += sum(math.log10(walk(context, 0, level, (256 | byte) >> (8 - level), byte >> (7 - level) & 1, True)[1]) for level in range(8))
        assert abs(rows[d].score - want) < 1e-4
    # Digits and case four bytes back tell what follows.
    long = frame(spark, ["".join(random.Random(i).choice(["1----x", "2----y", "A----u", "a----v"]) for _ in range(300)) for i in range(40)])
    assert max(r.bits_per_byte for r in weighting.score_texts(long).collect()) < 0.6


def test_toxicity_keeps_rare_words_beside_a_large_vocabulary(spark):
    rows, labels = [], []
    for i in range(8):
        filler = ["f%d" % k for k in range(140_000)]
        random.Random(i).shuffle(filler)
        rows.append((i, " ".join(filler), "en", "s", 1))
        labels.append((i, 1, 0))
    for i in range(100, 140):
        rows.append((i, f"{prose(i, 30)} vile{i % 10}", "en", "s", 1))
        labels.append((i, 1, int(i % 10 < 5)))
        rows.append((i + 100, prose(i + 100, 30), "en", "s", 1))
        labels.append((i + 100, 1, 1))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found, hashes = set(toxicity.fit(docs, marks).words.tolist()), toxicity.Hashes()
    assert len(found) > 140_000 and any(hashes[f"vile{i}"] in found for i in range(10))


def plain_kneser_ney(texts, d):
    """p[class](word, history) by dictionaries, None for the unknown word; and the words of both classes."""
    counts = [Counter(), Counter()]
    for text, toxic in texts:
        words = re.findall(r"\w+", (text or "").lower())
        counts[toxic].update(zip(["", *words], words))
    every = set(counts[0]) | set(counts[1])
    words = sorted({w for _, w in every})
    shared = Counter(w for _, w in every)
    base = len(every) + .5 * (len(words) + 1)
    p_shared = {w: (shared[w] + .5) / base for w in words} | {None: .5 / base}
    assert abs(sum(p_shared.values()) - 1) < 1e-9

    def model(c):
        k = Counter(w for (_, w), n in counts[c].items() if n)
        total = sum(k.values())
        taken = {w: min(k[w], d + d * math.sqrt(shared[w] * total / len(every))) for w in words}
        lower = {w: (k[w] - taken.get(w, 0) + sum(taken.values()) * p_shared[w]) / total for w in [*words, None]}
        size, mass = Counter(), Counter()
        for (h, w), n in counts[c].items():
            size[h] += n
            mass[h] += min(n, d)
        return lambda w, h: (max(counts[c][h, w] - d, 0) + mass[h] * lower[w]) / size[h] if size[h] else lower[w]
    return [model(0), model(1)], words, sorted({h for h, _ in every})


@pytest.mark.parametrize("d", [0.5, 1.0, 2.0])
def test_class_models_are_distributions_and_equal_plain_kneser_ney(spark, d):
    texts = [("a b a b c", 0), ("a b d, a c", 0), ("b vile a b", 1), (None, 1), ("vile vile b c É", 1), ("x", 0)]
    counted = spark.createDataFrame(texts, "text string, toxic int").repartition(3).mapInPandas(
        toxicity.bigram_counts, "key long, h long, w long, n0 long, n1 long").groupBy("key", "h", "w").agg({"n0": "sum", "n1": "sum"}).toDF("key", "h", "w", "n0", "n1")
    found = toxicity.kneser_ney(counted, (d,))
    plain, words, histories = plain_kneser_ney(texts, d)
    for c in (0, 1):
        for h in [*histories, "never seen"]:
            assert abs(sum(plain[c](w, h) for w in [*words, None]) - 1) < 1e-9
        assert abs(found.unknown[c, 0] - plain[c](None, "never seen")) < 1e-12
        lower = {r.w: r[f"lower{c}_0"] for r in found.words.collect()}
        assert abs(sum(lower.values()) + found.unknown[c, 0] - 1) < 1e-9
    hashes, model = toxicity.Hashes(), toxicity.with_bigrams(toxicity.word_models(found)[0], found, 0)
    text = "a b vile c never a É b"
    history, word = toxicity.bigrams(text, hashes)
    said = re.findall(r"\w+", text.lower())
    known = lambda w: w if w in words else None
    want = [math.log(plain[1](known(w), h) / plain[0](known(w), h)) for h, w in dict.fromkeys(zip(["", *said], said))]
    assert np.allclose(sorted(model.ratios(history, word)[1]), sorted(want), atol=1e-5)


def test_numbers_beside_numbers_are_proposed():
    for text, kind, parts in (("2024-01-05 555-123-4567", "phone", ["555-123-4567"]), ("555-123-4567 555-987-6543", "phone", ["555-123-4567", "555-987-6543"]),
                              ("4111/1111/1111/1111 12/26", "card", ["4111/1111/1111/1111"]), ("555-123-4567/555-987-6543", "phone", ["555-123-4567", "555-987-6543"]),
                              ("10.0.0.1 10.0.0.2", "ip", ["10.0.0.1", "10.0.0.2"]), ("12 (555) 123-4567", "phone", ["(555) 123-4567"])):
        found = [text[s:e] for k, s, e in pii.proposals(text) if k == kind]
        assert set(parts) <= set(found) and len(found) == len(set(found))
    assert len(pii.proposals("1 " * 20_000)) <= 20 * 20_000


def test_whole_numbers_go_before_parts_of_numbers():
    every = pii.BoostedTrees(5.0, [tuple(np.array([v], float if k in (1, 4) else np.int64) for k, v in enumerate((-1, 0, 0, 0, 0)))], 0.9)
    for text, want in (("2024-01-05 555-123-4567", ["555-123-4567"]), ("555-123-4567 555-987-6543", ["555-123-4567", "555-987-6543"])):
        assert [text[s:e] for _, s, e in pii.spans_of(text, every)[1]] == want


def test_language_letters_many_languages_and_plain_logits(spark):
    rows = [(i, f"{w}{w} {w}x {w}{i}", f"l{k:03d}", "s", 1) for k, w in enumerate("qwertyuiopasdfghjklzxcvbnm") for i in range(k * 40, k * 40 + 40)]
    docs = spark.createDataFrame([*rows, (9001, "² ½ Ⅷ ① 12", None, "s", 1), (9002, "ª", None, "s", 1), (9003, None, None, "s", 1)], SCHEMA)
    model = language.fit(docs, rows=26)
    assert len(model.languages) == 26
    got = {r.doc_id: r.lang_pred for r in language.identify_language(docs).collect()}
    assert got[9001] == got[9003] == "und" and got[9002] != "und"
    # A prediction by hand: the mean of the buckets' logits through the softmax.
    text = "wwww qx Éa"
    code = language.buckets(text)
    z = (np.mean([model.logits[b].astype(float) for b in code], axis=0) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert model.predict(text) == (model.languages[int(p.argmax())], pytest.approx(float(p.max())))


def test_averaged_embeddings_train_by_plain_gradients():
    rng = np.random.default_rng(0)
    bags = [(np.unique(rng.integers(0, 50, 6)), None) for _ in range(8)]
    bags = [(at, np.full(len(at), 1 / len(at))) for at, _ in bags]
    y = np.array([0, 1] * 4)
    e, w, b = language.train(bags, y, 2, dim=3, epochs=1, step=0.1, seed=5)
    r = np.random.default_rng(5)
    e2, w2, b2 = r.uniform(-1 / 3, 1 / 3, (1 << language.BITS, 3)), np.zeros((3, 2)), np.zeros(2)
    for i in r.permutation(8):
        at, share = bags[i]
        h = sum(s * e2[a] for a, s in zip(at, share))
        g = np.exp(h @ w2 + b2) / np.exp(h @ w2 + b2).sum() - np.eye(2)[y[i]]
        back = w2 @ g
        w2, b2 = w2 - 0.1 * np.outer(h, g), b2 - 0.1 * g
        for a, s in zip(at, share):
            e2[a] = e2[a] - 0.1 * 20 * s * back
    assert np.allclose(e, e2) and np.allclose(w, w2) and np.allclose(b, b2)


def test_pii_learns_from_every_document(spark):
    texts = ["write a@b.com or 1.2.3.999 now", "ping 10.0.0.1", "call +65 9123 4567 or 4111 1111 1111 1112"]
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.get(F.array(*map(F.lit, texts)), (F.col("id") % 3).cast("int")).alias("text"))
    counts = pii.candidate_counts(docs)
    want = 0
    for text in texts:
        base = pii.base_spans(text)
        want += 8_000 * (len(base) + sum(c not in base and not pii.valid(c[0], text[c[1]:c[2]]) for c in pii.proposals(text)))
    assert counts.agg(F.sum("n")).first()[0] == want
    cuts = [np.array([0.0, 1.0, 2.0, 3.0, 9.0])] * 19
    for most in (1_000, 2):
        cells, left = pii.binned_counts(counts, cuts, most)
        assert cells.agg(F.sum("n")).first()[0] == want and (most == 1_000 or max(map(len, left)) < 5)
        found = {tuple(np.searchsorted(own, v) for own, v in zip(left, r.x)) for r in counts.collect()}
        assert {tuple(r.bins) for r in cells.collect()} == found
    model = pii.fit(docs)
    assert model.trees and pii.fit(docs).bias == model.bias
