"""The two classifiers, near copies and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from chronoplex.llm import near_copies as N
from chronoplex.llm import quality as Q
from chronoplex.llm import toxicity as X
from chronoplex.llm.decontamination import decontaminate
from chronoplex.llm.labels import labelled_sample
from chronoplex.plans.lineage import cut

DOCS = "doc_id long, text string, lang string, n_chars long, label int, score double"
SF = "/root/testdata/sf0.01"


def labelled(spark, bad):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfgkl" for b in ("ar", "en", "ilo", "ost", "une")]
    rows, labels = [], []
    for i in range(400):
        text = rng.choices(words, k=rng.randint(5, 80))
        one = rng.random() < 0.4
        if one:
            text = bad(text, rng)
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), 10, 1, 0.1))
        labels.append((i, int(one), int(one)))
    rows += [(500, None, None, None, None, None), (501, "", "xx", 0, 0, 0.0), (None, "bar ben", "en", 7, 0, 0.0), (0, rows[0][1], "en", 10, 1, 0.1), (502, "bar " * 50_000, "en", 0, 0, 0.0)]
    labels += [(0, labels[0][1], labels[0][2]), (None, 1, 1), (600, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {a: b for a, b, _ in labels if b is not None}


def held_out_accuracy(rows, truth, folds, fold):
    own = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % folds == fold]
    assert all(r.held_out for r in own)
    return np.mean([r.predicted == truth[r.doc_id] for r in own])


def test_quality(spark):
    docs, labels, truth = labelled(spark, lambda t, rng: [w for w in t for _ in range(6)])
    got = Q.classify_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert held_out_accuracy(got, truth, 3, 1) > 0.95
    again = Q.classify_quality(docs.repartition(5).select("score", "text", "n_chars", "doc_id"), labels).collect()
    order = lambda rows: [r.score for r in sorted(rows, key=lambda r: (str(r.doc_id), r.score))]
    assert order(got) == pytest.approx(order(again))
    kept = Q.keep_good(docs, Q.fit_quality(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert Q.classify_quality(docs.limit(0), labels).collect() == []
    assert {r.score for r in Q.classify_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    f = Q.features(pa.array(["a b b c", "", "x y"]), np.array([7, 0, 3]))
    width = Q.BUCKETS + len(Q.STATISTICS)
    model = Q.FactorisationMachine(0.3, rng.normal(size=width).astype(np.float32), rng.normal(size=(width, Q.RANK)).astype(np.float32), np.zeros(len(Q.STATISTICS)), np.ones(len(Q.STATISTICS)))
    doc, feature, value = model.inputs(f)
    got, _ = model.margin(3, doc, feature, value)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        want = 0.3 + sum(model.linear[feature[i]] * value[i] for i in at)
        want += sum(model.factors[feature[i]] @ model.factors[feature[j]] * value[i] * value[j] for n, i in enumerate(at) for j in at[:n])
        assert np.isclose(got[d], want, rtol=1e-4)


def test_toxicity(spark):
    def insult(t, rng):
        for _ in range(3):
            t.insert(rng.randrange(len(t)), rng.choice(["scum", "Clown,", "trash."]))
        return t
    docs, labels, truth = labelled(spark, insult)
    got = X.classify_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert held_out_accuracy(got, truth, 5, 0) > 0.95
    assert X.classify_toxicity(docs.limit(0), labels).collect() == []
    assert {r.score for r in X.classify_toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_counts_all_labelled_rows(spark, monkeypatch):
    """Before, a bounded number of rows of either class took part."""
    monkeypatch.setattr(X, "ROWS_EACH_ROUND", 100)
    rows = [(i, f"plain words {i % 50}" + (" slur" if i % 2 else ""), "en") for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7000)], "doc_id long, toxic int")
    started, first = [], X._first_net
    monkeypatch.setattr(X, "_first_net", lambda ones, zeros, a, b: started.append((a, b, ones.max(), zeros.max())) or first(ones, zeros, a, b))
    net = X.fit_toxicity(docs, labels, folds=7000, held_out=-1)
    assert started[1] == (3500, 3500, 3500, 3500) and sum(started[0][:2]) < 7000
    got = {r.doc_id: r.score for r in X.score_toxicity(docs, net).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(7000))


def test_net_scores_do_not_depend_on_neighbours():
    net = X._start(np.random.default_rng(2))
    texts = ["one two three", "", "a", "b c", "one two three"]
    together = net.score(*X.word_buckets(pa.array(texts)))
    alone = [net.score(*X.word_buckets(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)


def jaccard(a, b):
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)))) for t in (a, b)]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_near_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, near = [], []
    for g in range(60):
        base = rng.choices(vocabulary, k=rng.randint(80, 400))
        copy = list(base)
        for at in rng.sample(range(len(copy)), max(1, len(copy) // 70)):
            copy[at] = "changed"
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(copy)), (3 * g + 2, " ".join(rng.choices(vocabulary, k=150)))]
        near.append(jaccard(rows[-3][1], rows[-2][1]))
    rows += [(900, None), (901, "one two"), (None, rows[0][1]), (902, "a " * 60_000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, anchor string, comp string")
    groups = N.near_copies(docs)
    got = {r.doc_id: r.component_id for r in groups.collect()}
    caught = [got.get(3 * g + 1) == 3 * g for g in range(60) if near[g] >= 0.8]
    assert len(caught) > 30 and np.mean(caught) >= 0.95
    assert got[None] == 0  # a copy of document 0 without an identifier
    assert not [i for i in got if i is not None and (i % 3 == 2 or i >= 900)]
    left = N.one_of_each_group(docs, groups)
    assert left.columns == docs.columns and left.count() == len(rows) - len(got) + len(set(got.values()))
    assert N.near_copies(docs.limit(0)).collect() == []


def planted_pair(rng, vocabulary, kind, n, at_least):
    """A text of n words and a copy of it, edited as long as their similarity stays at ``at_least`` or above."""
    base = rng.choices(vocabulary, k=n)
    if kind == "cut":
        base, copy = base, base[: 4 + int(np.ceil((n - 4) * at_least))]
    elif kind == "append":
        copy = base + rng.choices(vocabulary, k=int((n - 4) / at_least) - (n - 4))
    else:
        copy = list(base)
        for at in rng.sample(range(n), n):
            changed = copy[:at] + [f"new{rng.random()}"] + copy[at + 1:]
            if jaccard(" ".join(base), " ".join(changed)) < at_least:
                break
            copy = changed
    return " ".join(base), " ".join(copy)


@pytest.mark.parametrize("kind", ["substitute", "append", "cut"])
def test_near_copies_decide_by_the_exact_similarity(spark, kind):
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, want, wrong = [], set(), 0
    for g, at_least in enumerate([0.75, 0.78, 0.80, 0.82] * 25):
        base, copy = planted_pair(rng, vocabulary, kind, 300, at_least)
        rows += [(2 * g, base), (2 * g + 1, copy)]
        if jaccard(base, copy) >= 0.8:
            want.add(2 * g + 1)
    assert 45 <= len(want) <= 55
    got = {r.doc_id for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id != r.component_id}
    assert not got - want and len(got) >= 0.98 * len(want)


def test_near_copies_try_other_pairs_where_a_link_of_the_forest_fails(spark):
    # a row of texts, each near the next one only: similarities of 0.89 to the next, 0.79 to the one after it
    rng = random.Random(5)
    words = [f"w{k}" for k in range(2000)]
    texts = [words[17 * k: 17 * k + 300] for k in range(40)]
    order = rng.sample(range(40), 40)
    rows = [(i, " ".join(texts[k])) for i, k in enumerate(order)]
    assert jaccard(rows[order.index(0)][1], rows[order.index(1)][1]) >= 0.8 > jaccard(rows[order.index(0)][1], rows[order.index(2)][1])
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(i, 0, i == 0) for i in range(40)]


def test_rows_that_share_an_identifier_are_documents_of_their_own(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    base, alone, other = (rng.choices(vocabulary, k=200) for _ in range(3))
    copy = base[:100] + ["new"] + base[101:]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (2, " ".join(alone)), (None, " ".join(other)), (None, " ".join(other[:-3])), (None, "nobody else"),
            (5, " ".join(alone[:-2])), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    left = N.one_of_each_group(docs, N.near_copies(docs)).collect()
    got = sorted((str(r.doc_id), len((r.text or "").split())) for r in left)
    # of 2 the copy goes, the unrelated text stays; 5 loses its near copy of that, and of the texts without words one stays
    assert got == sorted([("1", 200), ("2", 200), ("5", 0), ("None", 2), *[("None", n) for n in (197, 200) if ("None", n) in got]])
    assert sum(i == "None" for i, _ in got) == 2


def test_merges_connect_what_every_pair_connects():
    rng = np.random.default_rng(4)
    n = 400
    anchor, home = np.sort(rng.integers(0, 12, n)), rng.random(n) < 0.4
    sketch = rng.integers(0, 2**63, (9, 2), dtype=np.uint64)[rng.integers(0, 9, n)] ^ (np.uint64(1) << rng.integers(0, 60, (n, 2), dtype=np.uint64))
    part, size = rng.integers(0, 150, n) * 7, rng.integers(50, 90, n)
    a, b = N.merges(3, N.Fraction(4, 5), anchor, part, size, sketch, home)

    def groups(pairs):
        root = {p: p for p in part.tolist()}
        for x, y in pairs:
            root = {k: root[x] if v == root[y] else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    every = [(part[x], part[y]) for x in range(n) for y in range(x) if anchor[x] == anchor[y] and (home[x] or home[y])
             and np.bitwise_count(sketch[x] ^ sketch[y]).sum() <= 3 and 5 * min(size[x], size[y]) >= 4 * max(size[x], size[y])]
    assert groups(zip(a.tolist(), b.tolist())) == groups(every) and len(a) == len({*part.tolist()}) - len(groups(every))


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == before
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b < a for a, b in zip(seen, seen[1:]))
    texts = [r.text for r in docs.select("text").collect()]
    assert len(texts) == len(set(texts)) == len(seen[-1])
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == seen[-1]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.count() == 0
    assert corpus_pipeline.packing(spark, docs, SF).count() == 0


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}", "en") for k in range(300)] + [(i, f"other {i}", "en") for i in range(2, 30)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    got = labelled_sample(docs.repartition(7), marks, "quality", 3, 1, 5, ("lang",)).collect()
    assert len(got) == len({r.doc_id for r in got}) == 10 and {r.lang for r in got} == {"en"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, labelled_sample(docs, marks, "quality", 3, 1, 5, ("lang",)).collect()))


def test_decontamination_leaves_other_rows_of_an_identifier(spark):
    item = " ".join(f"q{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "before " + item), (1, "clean text"), (None, item + " after"), (None, "also clean"), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = decontaminate(docs, benchmark).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == [("1", "clean text"), ("2", ""), ("None", "also clean")]
