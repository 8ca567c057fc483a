import random
import re
from fractions import Fraction

import numpy as np
import pytest

from chronoplex.llm import ngram_join as J
from chronoplex.llm import set_links as S

DOCS = "doc_id long, text string, key string, grp int"


def brute_set(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, num=85, den=100, k=4):
    """For each row its set's size and the smallest identifier that links reach."""
    sets = [brute_set(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                comp[root(a)] = root(b)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[root(x)] = min(i, low.get(root(x), i))
    return [(str(rows[x][0]), len(sets[x]), str(low.get(root(x)))) for x in range(len(rows))]


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            kind, at = rng.random() if len(w) > 2 else 0.6, rng.randrange(len(w))
            if kind < 0.5:
                w[at] = f"x{rng.random()}"
            elif kind < 0.75:
                w.insert(at, "y")
            else:
                w = w[:-1] if rng.random() < 0.5 else w[1:]
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(4):
        texts += family(rng, rng.choices(vocabulary, k=rng.choice([3, 12, 60, 150])), 25, 6)
    texts += [" ".join(shared + rng.choices(vocabulary, k=rng.randint(5, 40))) for _ in range(20)]  # a passage that many share
    texts += ["", None, "  \n", "one", "ONE", "one two three", "one two  three", "a b c d", "a b c d", "é É", "a " * 500]
    texts += family(rng, rng.choices(vocabulary, k=3000), 3, 30)
    rows = [(i * 13 % 4001, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, "nobody else"), (7, texts[1]), (7, texts[30]), (7, texts[30]), (9, "only nine words of its own are in here")]
    rng.shuffle(rows)
    return rows


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOCS).repartition(5)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.similar_components(docs, **options).collect())


@pytest.mark.parametrize("block", [2048, 8])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_SETS", block)  # 8: groups go over many blocks and take the second round
    rows = corpus(block)
    want = sorted(brute(rows))
    assert got(spark, rows) == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_other_similarity_and_shingle_size(spark):
    rows = corpus(3)
    assert got(spark, rows, words_per_shingle=2, similarity=Fraction(3, 5)) == sorted(brute(rows, 3, 5, 2))


def test_empty_table_and_only_empty_texts(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, ""), (2, None), (None, " ")]) == sorted([("1", 0, "1"), ("2", 0, "2"), ("None", 0, "None")])


@pytest.mark.parametrize("seed", range(6))
def test_block_links_connect_what_is_similar(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(6):
        base = rng.choice(500, rng.integers(1, 120), replace=False)
        sets += [np.unique(np.where(rng.random(len(base)) < rng.uniform(0, 0.12), rng.integers(0, 10**6, len(base)), base)) for _ in range(15)]
    sets.sort(key=len)
    index = S.Index(np.concatenate(sets), np.array(list(map(len, sets))), Fraction(4, 5))
    share = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    # derived answers are those of a full count
    for x in range(len(sets)):
        shared = [len(np.intersect1d(sets[x], s)) for s in sets]
        assert [v for y, v in enumerate(index.overlaps(x)) if y != x] == [v for y, v in enumerate(shared) if y != x]
    left, right = index.links(np.arange(len(sets)), np.ones(len(sets), dtype=bool))
    assert all(share(a, b) >= 0.8 for a, b in zip(left, right))
    label = list(range(len(sets)))
    for a, b in zip(left, right):
        label = [label[a] if c == label[b] else c for c in label]
    assert len(left) == len(sets) - len(set(label))  # a forest
    assert all(label[a] == label[b] for a in range(len(sets)) for b in range(a) if share(a, b) >= 0.8)


def test_skip_blocks_leave_no_candidate_out_and_skip(monkeypatch):
    rng = np.random.default_rng(1)
    sets = sorted((np.unique(rng.integers(0, 300, rng.integers(20, 90))) for _ in range(80)), key=len)
    index = S.Index(np.concatenate(sets), np.array(list(map(len, sets))), Fraction(1, 2))
    met = [set(index.candidates(x).tolist()) for x in range(len(sets))]
    near = {(a, b) for a in range(80) for b in range(80) if a != b and 2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))}
    assert all(b in met[a] for a, b in near) and sum(map(len, met)) < 80 * 80


def test_pivot_of_a_large_group_is_no_bottleneck(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_SETS", 50)
    rng = random.Random(2)
    rows = list(enumerate(family(rng, [f"v{i}" for i in range(200)], 400, 5)))
    assert got(spark, rows) == sorted(brute(rows))
