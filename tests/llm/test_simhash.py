import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from chronoplex.llm import simhash as S

DOCS = "doc_id long, text string, fp string, anchor int"


def brute_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, threshold):
    low = {}
    left = set(range(len(fps)))
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if bin(fps[a][1] ^ fps[b][1]).count("1") <= threshold}
            left -= near
            todo += near
        ids = [fps[i][0] for i in group if fps[i][0] is not None]
        low.update({i: min(ids) if ids else None for i in group})
    return low


@pytest.mark.parametrize("text", ["", " \n\t", "One", "one TWO", "a b c", "Äpfel É b  c\x0bd", "x " * 400, "the end of the road of the end"])
@pytest.mark.parametrize("k", [3, 5])
def test_fingerprint(text, k):
    assert S.shingle_fingerprint(text, k) == brute_fingerprint(text, k)


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_pairs_within_threshold_meet_at_a_home(threshold):
    rng = random.Random(threshold)
    golay = S.Golay(threshold)
    fps = np.array([rng.getrandbits(64) for _ in range(60)], dtype=np.uint64)
    other = fps.copy()
    for i in range(len(other)):
        for b in rng.sample(range(64), rng.randint(0, threshold)):
            other[i] ^= np.uint64(1 << b)
    row, anchor, home = S.anchors(fps.view(np.int64), golay, threshold)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
    assert len(homes) == len(fps) == home.sum()
    row2, anchor2, _ = S.anchors(other.view(np.int64), golay, threshold)
    reached = set(zip(row2.tolist(), anchor2.tolist()))
    assert all((i, a) in reached for i, a in homes.items())


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 60, 200]))) for _ in range(25)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(rng.randint(0, 6)):
            w = b.split()
            if len(w) > 50:
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            texts.append(" ".join(w))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (None, "  "), (5002, texts[0]), (5002, texts[0])]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, fp="x", anchor=1) for i, t in rows], DOCS)
    got = S.simhash_components(docs, threshold=3).collect()
    fps = [(i, brute_fingerprint(t or "", 3)) for i, t in rows]
    low = brute_components(fps, 3)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(i), f"{f:016x}", low[k]) for k, (i, f) in enumerate(fps))
    assert len({r.component_id for r in got}) < len({f for _, f in fps})


def test_large_group_stays_linear(spark):
    docs = spark.createDataFrame([(i, 0) for i in range(3000)], "doc_id long, x int")
    fps = docs.selectExpr("doc_id", "shiftleft(1L, cast(doc_id % 60 as int)) | shiftleft(1L, cast(doc_id div 60 as int)) as fp")
    found = S.linked(fps, 2)
    assert found.select("comp").distinct().count() == 1 and found.count() == fps.select("fp").distinct().count()


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], DOCS)).collect() == []
