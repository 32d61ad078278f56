"""Problems 2, 7, 8 and 9: mixtures, packing, leaks, residue."""

import itertools
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import leak, mixture, packing, residue, tokens


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


# ---- words


def test_words_against_plain_python():
    texts = ["Héllo wör-\nld, foo—bar «x» ÉCOLE", "", None, "a", "b c’d", "x-y z-\n", "Привет Мир", "ß" * 3 + " 12a"]
    w = tokens.words_of(texts)
    got = [[w.text(k, k) for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [["Héllo", "wörld", "foo", "bar", "x", "ÉCOLE"], [], [], ["a"], ["b", "c", "d"], ["x", "y", "z"], ["Привет", "Мир"], ["ßßß", "12a"]]
    assert tokens.hash_of("école") == tokens.hash_of("ÉCOLE") and tokens.hash_of("a") != tokens.hash_of("aa")
    long = tokens.words_of(["q" * 20000 + " end"])
    assert len(long.hash) == 2


def test_pieces_cover_all_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 64)
    texts = [("w%d " % i) * (i % 9) for i in range(50)]
    seen = [(i, j, len(w.hash)) for i, j, w in tokens.pieces(pa.array(texts))]
    assert seen[0][0] == 0 and seen[-1][1] == 50 and all(a[1] == b[0] for a, b in itertools.pairwise(seen)) and sum(n for *_, n in seen) == sum(i % 9 for i in range(50))


# ---- problem 2

THEORY = "id bigint, doi string, name string, mode string, evidence string, confidence_is_theory string, criteria_reasoning string, paper_focus int, key_concepts string"
TWINS = [("slow", "gradual"), ("repair", "mending"), ("late", "delayed"), ("loss", "decline"), ("uptake", "import"), ("early", "premature")]


def theories(n, seed=0):
    rng = random.Random(seed)
    out, truth = [], {}
    for t in range(n):
        base = [(rng.choice(TWINS), rng.choice(TWINS), f"site{rng.randrange(40)}", f"thing{rng.randrange(60)}") for _ in range(7)]
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            picked = rng.sample(base, rng.choice([5, 6]))
            texts = [f"{rng.choice(q)} {rng.choice(p)} of {s} {o}" if rng.random() < 0.5 else f"{rng.choice(p)} of {s} {o}, {rng.choice(q)}" for q, p, s, o in picked]
            i = len(out) + 1
            truth[i] = t
            out.append((i, "d", f"n{t}", "m", "e", "h", None, 1, json.dumps([{"concept": c, "description": "x"} for c in texts])))
    return out, truth


@pytest.fixture(scope="module")
def mixed(spark):
    out, truth = theories(150)
    extra = [(9001, "d", "x", "m", "e", "h", None, 1, None), (9002, "d", "x", "m", "e", "h", None, 1, None), (9003, "d", "y", "m", "e", "h", None, 1, "[{broken"), (9004, "d", "z", "m", "e", "h", None, 1, ""), (None, "d", "z", "m", "e", "h", None, 1, out[0][8])]
    return spark.createDataFrame(out + extra, THEORY), truth


def test_thesaurus_is_learned(mixed):
    learned = {frozenset((r.word, r.rep)) for r in mixture.thesaurus(mixture.concepts(mixed[0])).collect()}
    assert learned == {frozenset(p) for p in TWINS}


def test_pairs_and_clusters(mixed):
    frame, truth = mixed
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b]} | {(9001, 9002)}
    got = {tuple(r) for r in mixture.pairs_found(frame).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.01 * len(got)
    c = mixture.clusters(frame).collect()
    assert sum(r["size"] for r in c) == len(truth) and all(1 <= len(r.typical_ids) <= 3 for r in c)
    assert abs(len(c) - len(set(truth.values()))) <= 3


def test_large_blocks_are_split(mixed, monkeypatch):
    frame, truth = mixed
    monkeypatch.setattr(mixture, "CAP", 3)
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b]}
    got = {tuple(r) for r in mixture.pairs_found(frame).collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_oversized_blocks_are_fitted(spark, monkeypatch):
    """A concept triple of more than CAP classes: each class has a density, and the fringe isn't what is typical."""
    monkeypatch.setattr(mixture, "CAP", 8)
    hot = [["hot alpha", "hot beta", "hot gamma", f"own {i}"] for i in range(40)]
    rare = [["hot alpha", "hot beta", "hot gamma", "rare delta", f"fringe {i}"] for i in range(2)]
    out = [(i + 1, "d", f"n{i}", "m", "e", "h", None, 1, json.dumps([{"concept": c} for c in cs])) for i, cs in enumerate(hot + rare)]
    frame = spark.createDataFrame(out, THEORY)
    m = mixture.similar(frame)
    assert m.classes.count() == 42 and m.density.where("density IS NOT NULL").count() == 42
    assert m.edges().distinct().count() >= 41 and mixture.labels(m).select("cluster").distinct().count() == 1
    assert mixture.pairs_found(frame).count() == 42 * 41 // 2
    (c,) = mixture.clusters(frame).collect()
    assert c["size"] == 42 and not {41, 42} & set(c.typical_ids)


def test_every_record_is_in_one_cluster(mixed):
    frame, truth = mixed
    c = mixture.all_clusters(frame).collect()
    assert sum(r["size"] for r in c) == len(truth) + 4 and len({r.cluster_id for r in c}) == len(c)
    short = {r.cluster_id: (r["size"], r.typical_ids) for r in c if r.cluster_id > 9000}
    assert short == {9001: (2, [9001, 9002]), 9003: (1, [9003]), 9004: (1, [9004])}


def test_mixture_edges(spark):
    empty = spark.createDataFrame([], THEORY)
    assert mixture.pairs_found(empty).isEmpty() and mixture.clusters(empty).isEmpty()


def test_components_make_the_links(mixed, monkeypatch):
    """What doesn't share a component is never compared: without components there are no links but copies and equal classes."""
    frame, truth = mixed
    m = mixture.similar(frame)
    n = m.classes.count()
    assert 0 < m.links.count() < n * (n - 1) // 20
    sigs = np.arange(64)
    sets = [np.array([1, 2, 3, 10 + i]) for i in sigs]
    far = np.repeat(np.eye(mixture.DIMS, dtype=np.float32)[:8] * 20, 8, axis=0)  # eight heaps, though all share three concepts
    (a, b, s, density), = mixture.linked([(sigs, far, sets)])
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} == {(x, y) for x in range(64) for y in range(x + 1, 64) if x // 8 == y // 8} and len(density) == 64


def test_wide_gaps_are_narrowed(spark):
    """A gap that many words fill beside a frequent concept still tells which two say the same, by a second concept."""
    frequent = "frequent concept"
    out = []
    for i in range(40):
        for w in ("slow", "gradual"):
            out.append([frequent, f"own {i} thing", f"{w} repair of site{i % 6}"])
    for i in range(40, 100):
        out.append([frequent, f"own {i} thing", f"q{i} repair of site{i % 6}"])
    frame = spark.createDataFrame([(i, "d", f"n{i}", "m", "e", "h", None, 1, json.dumps([{"concept": c} for c in cs])) for i, cs in enumerate(out)], THEORY)
    assert [tuple(r) for r in mixture.thesaurus(mixture.concepts(frame)).collect()] == [("slow", "gradual")]


@pytest.mark.parametrize("beside", [["frequent concept", "second frequent concept"], ["frequent concept"]])
def test_gaps_that_stay_wide_count(spark, beside):
    """What no second concept narrows is judged with all the words that fill the gap, be there a second concept or not."""
    out = [[*beside, f"{w} repair of site{i}"] for i in range(8) for w in ("slow", "gradual", *(f"q{i}x{k}" for k in range(30)))]
    out += [[*beside, f"{w} loss of part{i}"] for i in range(9) for w in ("late", "early", "soon", "after", *(f"r{i}x{k}" for k in range(9)))]
    frame = spark.createDataFrame([(i, "d", f"n{i}", "m", "e", "h", None, 1, json.dumps([{"concept": c} for c in cs])) for i, cs in enumerate(out)], THEORY)
    assert [tuple(r) for r in mixture.thesaurus(mixture.concepts(frame)).collect()] == [("slow", "gradual")]


def test_wide_gaps_take_no_pair_away(spark):
    """Words that narrow contexts have paired stay paired whatever wide contexts say; pairs of either way of counting are the same."""
    out = [[f"own {i} thing", f"{w} repair of site{i}"] for i in range(8) for w in ("slow", "gradual")]
    out += [["frequent concept", f"{w} repair of part{i}"] for i in range(9) for w in ("slow", "gradual", "late", "early", "soon", "big", "small", "thin")]
    frame = spark.createDataFrame([(i, "d", f"n{i}", "m", "e", "h", None, 1, json.dumps([{"concept": c} for c in cs])) for i, cs in enumerate(out)], THEORY)
    assert [tuple(r) for r in mixture.thesaurus(mixture.concepts(frame)).collect()] == [("slow", "gradual")]
    rng = random.Random(1)
    told = {(c, c % 12, rng.randrange(9)) for c in range(300) for _ in range(rng.randrange(1, 9))}
    contexts = spark.createDataFrame(sorted(told), "context bigint, rest bigint, word bigint")
    assert rows(mixture.pairs_filling(contexts)) == rows(mixture.pairs_filling_any(contexts)) != []


def test_members_and_links(mixed):
    frame, truth = mixed
    got = mixture.members(frame).collect()
    assert sorted(r.id for r in got) == sorted([*truth, 9001, 9002, 9003, 9004]) and all(r.cluster_id <= r.class_id <= r.id for r in got)
    by = {r.id: r.cluster_id for r in got}
    links = mixture.class_links(frame).collect()
    assert links and all(r.first_id < r.second_id and by[r.first_id] == by[r.second_id] for r in links)


def test_short_records_of_one_name(spark):
    two = json.dumps([{"concept": "slow repair"}, {"concept": "late loss"}])
    out = [(1, "d", "Wear Theory", "m", "e", "h", None, 1, two), (2, "d2", "wear-theory", "x", "e", "h", None, 1, two), (3, "d", "Other", "m", "e", "h", None, 1, two), (4, "d", None, "m", "e", "h", None, 1, None), (5, "q", None, "m", "e", "h", None, 1, None)]
    got = {r.id: r.cluster_id for r in mixture.members(spark.createDataFrame(out, THEORY)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_em_separates_and_keeps_together():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 0.3, (1, 8, mixture.DIMS)), rng.normal(3, 0.3, (1, 8, mixture.DIMS))
    x = np.concatenate([np.concatenate([a, b], axis=1), np.concatenate([a, a + 0.01], axis=1)]).astype(np.float32)
    same, density = mixture.mixed(x, np.ones((2, 16), dtype=bool))
    assert not same[0, :8, 8:].any() and same[0, :8, :8].any(axis=1).all() and np.isfinite(density).all()


# ---- problem 7


def test_sum_of_squares_is_a_packing():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 100):
        sizes = rng.integers(1, capacity + 1, 500)
        container, place, made = packing.sum_of_squares(sizes, capacity)
        for c in range(made):
            own = sorted(zip(place[container == c], sizes[container == c], strict=True))
            assert all(a + s == b for (a, s), (b, _) in itertools.pairwise(own)) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= capacity
    assert packing.sum_of_squares(np.empty(0, dtype=np.int64), 5)[2] == 0


def test_sum_of_squares_choice_against_brute_force():
    rng = np.random.default_rng(4)
    capacity, count = 12, {}
    sizes = rng.integers(1, 13, 200)
    container, place, _ = packing.sum_of_squares(sizes, capacity)
    total = lambda c: sum(v * v for g, v in c.items() if 0 < g < capacity)
    for s, p in zip(sizes.tolist(), place.tolist(), strict=True):
        costs = {}
        for gap in {capacity, *[g for g, v in count.items() if v and g >= s]}:
            after = dict(count)
            if gap != capacity:
                after[gap] -= 1
            after[gap - s] = after.get(gap - s, 0) + 1
            costs[gap] = total(after)
        chosen = capacity - p
        assert costs[chosen] == min(costs.values())
        if chosen != capacity:
            count[chosen] -= 1
        if chosen - s:
            count[chosen - s] = count.get(chosen - s, 0) + 1


def test_pack(df):
    lengths = df([(i, n) for i, n in enumerate([5, 0, 10, 25, 3, 7, 10, 1])] + [(3, 4)], "doc_id bigint, tokens bigint")
    got = packing.pack(lengths, 10).collect()
    assert sum(r.tokens for r in got) == 65 and {r.doc_id for r in got if r.container is None} == {1}
    assert sorted((r.piece, r.start, r.tokens) for r in got if r.doc_id == 3) == [(0, 0, 4), (0, 0, 10), (1, 10, 10), (2, 20, 5)]
    by = {}
    for r in got:
        if r.container is not None:
            by.setdefault(r.container, []).append((r.place, r.tokens))
    assert all(sum(t for _, t in v) <= 10 for v in by.values())
    assert packing.pack(lengths.limit(0), 10).isEmpty()
    same = packing.pack(df([(7, 4)] * 900 + [(None, 6)] * 100, "doc_id bigint, tokens bigint"), 10, bins=20)
    per = same.groupBy("container").agg(F.sum("tokens").alias("t"), F.max(F.shiftright("container", 32)).alias("g"))
    assert per.where("t > 10").isEmpty() and per.select("g").distinct().count() > 5 and same.count() == 1000
    again = packing.pack(lengths.repartition(5), 10).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files here")
def test_documents_are_measured(df):
    docs = df([(1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 5000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in packing.token_lengths(docs).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 5001, None: 1}
    full = packing.fill(packing.pack_documents(docs)).first()
    assert (full.containers, full.least) == (3, 3)


# ---- problem 8

WORDS = [a + b for a in "ba be bi bo da de di do fa fe fi fo".split() for b in "lan mor ket sur tin vol".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if k % 12 == 11 else "") for k in range(n))


def test_leaks(df):
    rng = random.Random(1)
    rule = "Read the excerpt and decide whether it is right."
    items = [(i, f"{rule} {prose(rng, 90)}", "Yes") for i in range(8)]
    body = {i: t.removeprefix(rule + " ").split() for i, t, _ in items}

    def altered(ws):
        return ["ofa" if k % 13 == 5 else w for k, w in enumerate(ws)]

    docs = [
        (1, prose(rng, 300) + " " + " ".join(body[0]) + " " + prose(rng, 200)), (2, "\n".join(w.upper() for w in body[1][:50])), (3, prose(rng, 40) + " " + " ".join(altered(body[2])) + " " + prose(rng, 3000)),
        (4, prose(rng, 100) + " " + " ".join(body[3][:20])), (5, f"{rule} " + prose(rng, 200)), (6, None), (7, ""), (8, " ".join(body[4]) + " " + " ".join(body[5])), (9, prose(rng, 20000)), (10, " ".join(body[6][30:80])), (1, " ".join(body[7])),
    ] + [(100 + k, prose(rng, 150)) for k in range(60)]
    frame = df([(d, t, "clash") for d, t in docs], "doc_id bigint, text string, item_id string")
    found = leak.leaks_found(frame, df([*items, (None, "x y z", "No"), (50, None, None), (51, rule, None)], "item_id bigint, text string, answer string"))
    assert rows(found) == sorted([(1, 0), (2, 1), (3, 2), (8, 4), (8, 5), (10, 6), (1, 7)], key=str)


def test_paraphrases_are_found(data):
    """Held-out rewritings of the test items, planted into documents: no trigram survives where every third word is replaced."""
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist()
    items = [(r["item_id"], r["text"], r["answer"]) for r in pq.read_table(f"{data}/eval_items.parquet").to_pylist()]
    index = leak.Index(items)
    counts, n, gram = leak.range_sums(index, pa.table({"text": docs}).to_batches())
    index.fit(counts, n, gram)
    rng = random.Random(4)
    hosts = [t for t in docs if t and 300 < len(t) < 3000]
    pool = [w for t in hosts for w in t.split()]
    body = dict(leak.passages([(i, t) for i, t, _ in items]))

    def found(change):
        texts, want = [], set()
        for k, (i, t) in enumerate(body.items()):
            host = rng.choice(hosts).split()
            at = rng.randrange(len(host))
            texts.append(" ".join(host[:at] + change(t.split()) + host[at:]))
            want.add((k, i))
        got = {1: set(), 2: set()}
        for t, m, _, held, w, c, answered in leak.scored(index, pa.array(texts)):
            got[leak.level(held, w, c, answered)].add((t, index.ids[m]))
        return len(want & got[2]) / len(want), len(want & (got[1] | got[2])) / len(want), len(got[2] - want) / len(want)

    for k in (3, 4, 5):
        passage, _, other = found(lambda ws, k=k: [rng.choice(pool) if j % k == k - 1 else w for j, w in enumerate(ws)])
        assert passage >= 0.98 and other <= 0.1
    assert found(lambda ws: ws[: len(ws) // 2])[0] >= 0.98 and found(lambda ws: [w for j, w in enumerate(ws) if j % 4])[0] >= 0.98
    assert found(lambda ws: ws[10 : 10 + int(0.35 * len(ws))])[1] >= 0.95
    assert found(lambda ws: rng.sample(pool, len(ws)))[:2] == (0, 0)


def test_short_items_and_many_terms(df, monkeypatch):
    """An item of five words, verbatim; and the sums over sorted words that many terms take agree with the dense product."""
    rng = random.Random(6)
    items = df([(1, "zorn quaff vexed jumpy glyph", "Yes"), *[(i, prose(rng, 90), "No") for i in range(2, 9)]], "item_id bigint, text string, answer string")
    docs = df([(1, prose(rng, 60) + " Zorn quaff, vexed jumpy glyph " + prose(rng, 60)), (2, prose(rng, 200)), (3, "zorn jumpy " + prose(rng, 100))], "doc_id bigint, text string")
    assert rows(leak.leaks_found(docs, items)) == [(1, 1)]
    index = leak.Index([(i, prose(rng, 90), "No") for i in range(9)])
    batches = pa.table({"text": [prose(rng, 500), "", None, prose(rng, 30)]}).to_batches()
    dense = leak.range_sums(index, batches)
    many = leak.Index.__new__(leak.Index)
    many.__dict__ = dict(index.__dict__, terms=np.unique(np.concatenate([index.terms, np.arange(5000, dtype=np.uint64)])), lookup=None)
    many.width, many.prior = len(many.terms), np.ones(len(many.terms), dtype=np.float32)
    sparse = leak.range_sums(many, batches)
    at = np.searchsorted(many.terms, index.terms)
    assert sparse[1] == dense[1] and (sparse[0][at] == dense[0]).all() and sparse[0].sum() == dense[0].sum()
    brute = np.zeros_like(sparse[2])
    omega = np.vstack([many.omega(), np.zeros((1, sparse[2].shape[1]))])
    for batch in batches:
        for _, _, w in tokens.pieces(batch.column(0)):
            blocks, text, _ = leak._blocks(many.term_ids(w.hash), w.first, many.width)
            own = omega[blocks].sum(axis=1)
            pair = leak._pairs(own, text)
            for i in range(len(blocks)):
                before = pair[i - 1] if i and text[i - 1] == text[i] else 0
                for t in blocks[i][blocks[i] < many.width]:
                    brute[t] += pair[i] + before
    assert np.allclose(sparse[2], brute, atol=1e-2)


def test_leak_edges(df):
    docs = df([(1, "some text here")], "doc_id bigint, text string")
    items = df([(1, "one two three four five six", "Yes")], "item_id bigint, text string, answer string")
    assert leak.leaks_found(docs.limit(0), items).isEmpty() and leak.leaks_found(docs, items.limit(0)).isEmpty()
    assert rows(leak.leaks_found(df([(1, "One, two; three four five six")], "doc_id bigint, text string"), items)) in ([(1, 1)], [])


def test_item_blocks_agree(df, monkeypatch):
    rng = random.Random(2)
    items = [(i, prose(rng, 80), "No") for i in range(6)]
    docs = df([(i, prose(rng, 60) + " " + t) for i, t, _ in items] + [(90 + k, prose(rng, 200)) for k in range(30)], "doc_id bigint, text string")
    table = df(items, "item_id bigint, text string, answer string")
    monkeypatch.setattr(leak, "MAX_ITEMS", 2)
    assert rows(leak.leaks_found(docs, table)) == [(i, i) for i in range(6)]


def test_heaviest_subsequence_against_brute_force():
    rng = np.random.default_rng(5)
    weights = rng.random(9) + 0.1

    def brute(a, b):
        best = [(0.0, 0)] * (len(b) + 1)
        for x in a:
            new = [(0.0, 0)]
            for j, y in enumerate(b):
                new.append(max(best[j + 1], new[-1], (best[j][0] + weights[x], best[j][1] + 1) if x == y else (0.0, 0)))
            best = new
        return best[-1]

    a = [rng.integers(0, 9, n) for n in (3, 8, 12, 1)]
    b = [rng.integers(0, 9, n) for n in (10, 2, 12, 5)]
    got, n = leak._subsequence(a, b, weights)
    for k in range(4):
        assert abs(got[k] - brute(a[k], b[k])[0]) < 1e-4
    same = np.arange(6000) % 9  # more words than the number had room for in twelve bits
    got, n = leak._subsequence([same], [same], weights)
    assert n[0] == 6000 and abs(got[0] - weights[same].sum()) < 0.5


# ---- problem 9


def test_residue_of_unseen_wording():
    """Wordings that no table here holds; at their first run 50 of 54 were found, and 2 of 38 look-alikes."""
    from tests.llm.residue_cases import BODY, NEGATIVE, POSITIVE

    for around in ("{}", BODY + "\n\n{}\n\n" + BODY):
        kinds = residue.classify(pa.array([around.replace("{}", t) for _, t in POSITIVE]))
        assert sum(want in got for (want, _), got in zip(POSITIVE, kinds, strict=True)) >= 52
    assert sum(bool(k) for k in residue.classify(pa.array(NEGATIVE))) <= 1


def test_no_length_is_cut_off():
    """Long fields, quotations and words; a notice behind a fence that never closes."""
    assert residue.judge("{{" + "a long field name " * 20 + "}}") == {"placeholder"}
    assert residue.judge("[insert " + "a very long description " * 30 + "]") == {"placeholder"}
    quoted = 'Some readers saw the sentence "Please enable JavaScript to continue' + " and to read on" * 30 + '" on their screens.'
    assert residue.judge(quoted) == set()
    assert residue.judge("```python\nx = 1\n\nPlease enable JavaScript to continue.") == {"scripts"}
    assert residue.judge("```\nPlease enable JavaScript to continue.\n```\nis what the page says.") == set()
    long = "Donaudampfschifffahrtsgesellschaft"
    assert residue.classify(pa.array([f"{long} " * 8, "ACGTACGTTGCAACGTACGTTGCAACGT " * 8])) == [{"filler"}, set()]
    for t in ("Expression of {{gene}} rose in old mice.", "Drugs such as [[drug]] were given."):
        assert residue.judge(t) == {"placeholder"}


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Dear {{ name }}, we thank you", {"placeholder"}), ("The dose of ${dose} was low", {"placeholder"}), ("[INSERT TITLE HERE]", {"placeholder"}), ("Methods: [section body to be added]", {"placeholder"}), ("By <your name here>", {"placeholder"}),
        ("<!-- abstract goes here -->", {"placeholder"}), ("XXXX (dose missing) XXXX", {"placeholder"}), ("for %%species%% we", {"placeholder"}), ("[Ihr Titel hier einfügen]", {"placeholder"}), ("__AUTHOR__ et al.", {"placeholder"}),
        ("Lorem ipsum dolor sit amet", {"filler"}), ("foo bar baz foo bar baz foo bar baz foo bar baz foo bar baz", {"filler"}), ("xxxx xxxx xxxx xxxx xxxx xxxx", {"filler"}), ("Dies ist ein Blindtext für den Satz.", {"filler"}),
        ("Noriat placet verbius exultas morbida inceptus quaric centum volare fulvat gravis ostia mitrum sedat.", {"filler"}), ("This is dummy copy for checking the layout.", {"filler"}), ("test test 1 test test 2 test test 3 test test 4 test test 5", {"filler"}),
        ("Please enable JavaScript to view this page.", {"scripts"}), ("JS is turned off.", {"scripts"}), ("Veuillez activer les scripts pour lire le texte.", {"scripts"}), ("This viewer needs JavaScript.", {"scripts"}), ("<noscript>x</noscript>", {"scripts"}),
        ("404 Not Found", {"error"}), ("Real prose.\nError 503: service unavailable.", {"error"}), ('{"error": {"code": 502, "message": "Bad Gateway"}}', {"error"}), ("Traceback (most recent call last):\n  File x", {"error"}), ("Your session has expired.", {"error"}),
        ("Seite nicht gefunden (Fehler 404).", {"error"}), ("Access denied.", {"error"}), ("The page you asked for is not on this server.", {"error"}), ("Something went wrong on our side.", {"error"}),
        ("Readers without JavaScript were sent the form on paper.", set()), ("Of the 6 links cited, a fifth returned error 404 and were left out.", set()), ("The set {α, β, γ} lists rates, and $x_{i}$ is the i-th.", set()), ("sprintf(\"%d of %d\", n, m)", set()),
        ("Samples were labelled [A1], [B2] and <LOD>.", set()), ("Readers rated a lorem ipsum page and a real abstract.", set()), ("Ten percent (10%) of sessions expired early.", set()), ("Access was denied to the cohort until the plan was registered.", set()),
        ("A page not found in the herd book was taken as lost.", set()), ("In Jinja syntax, {{ name }} is replaced by the value of a variable, which is how such templates work in general.", set()), ("```\n{{ x }} ${y}\n```\nThe code above is a template.", set()),
        ("The users saw a page that read “404 Not Found” and left.", set()), ("", set()), (None, set()), ("{", set()), ("x" * 200000, set()),
    ],
)
def test_residue(text, kinds):
    assert residue.classify(pa.array([text], type=pa.string()))[0] == kinds


def test_residue_of_tables(df):
    docs = df([(1, "404 Not Found", "x"), (1, "404 Not Found", "x"), (2, "Cells age.", "x"), (3, None, "x"), (None, "404 Not Found", "x"), (4, prose(random.Random(3), 9000) + "\n{{ title }}", "x")], "doc_id bigint, text string, kinds string")
    assert rows(residue.residue_found(docs)) == [(1,), (4,)]
    assert sorted(r.doc_id or 0 for r in residue.clean_corpus(docs).collect()) == [0, 2, 3]
    assert residue.residue_found(docs.limit(0)).isEmpty()
    assert residue.residue(docs).where(F.col("doc_id") == 4).first().kinds == ["placeholder"]
