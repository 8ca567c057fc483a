import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronoplex.llm import language_model as L

DOCS = "doc_id long, text string, chunk int, score string"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


def brute(rows, trains):
    """Plain dictionaries; every document is (id, text)."""
    pairs, words = Counter(), Counter()
    for (_, t), learn in zip(rows, trains):
        if learn:
            seq = tokens(t)
            words.update(seq)
            pairs.update(zip(["<s>"] + seq[:-1], seq))
    follow, before = defaultdict(Counter), Counter()
    for (a, b), n in pairs.items():
        follow[a][b] = n
        before[b] += 1
    kinds = lambda c: [sum(x == k for x in c) for k in (1, 2, 3, 4)]
    upper, lower = L.discounts(*kinds(pairs.values())), L.discounts(*kinds(before.values()))
    cut = lambda d, n: d[min(n, 3)]
    v, n, s = len(words), sum(words.values()), sum(before.values())
    left = sum(cut(lower, x) for x in before.values()) / s if s else 1

    def p(a, b):
        low = left / (v + 1) + (max(before[b] - cut(lower, before[b]), 0) / s if s else 0)
        den = sum(follow[a].values())
        if not den:
            return low
        return max(pairs[a, b] - cut(upper, pairs[a, b]), 0) / den + sum(cut(upper, x) for x in follow[a].values()) / den * low

    out = []
    for (i, t), learn in zip(rows, trains):
        seq = tokens(t)
        out.append((i, not learn, len(seq), sum(words[w] > 0 for w in seq), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in seq),
                    sum(math.log10(p(a, b)) for a, b in zip(["<s>"] + seq[:-1], seq))))
    return out, p, words


def corpus():
    rng = random.Random(3)
    vocabulary = ["The", "of", "a", "road", "Éa", "x."] + [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(rng.choices(vocabulary, [40, 30, 20, 5, 5, 5] + [1] * 80, k=rng.randint(1, 40)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "unseen words only here"), (3, rows[3][1]), (None, "the road"), (104, "the " * 3000)]


@pytest.mark.parametrize("entries,chunk", [(10 ** 6, 2_000_000), (50, 300)])
def test_scores_match_brute_force(spark, entries, chunk):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(3)
    trains = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    got = L.score_texts(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2, shard_entries=entries, chunk_tokens=chunk).collect()
    want, p, words = brute(rows, trains)
    order = lambda r: (str(r[0]), r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    assert math.isclose(sum(p("the", w) for w in words) + p("the", "never"), 1, rel_tol=1e-9)


def test_no_rows_and_no_training_rows(spark):
    assert L.score_documents(spark.createDataFrame([], DOCS)).collect() == []
    rows = L.score_texts(spark.createDataFrame([(1, "a b", 1, "x")], DOCS), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(3, 0, 0, 0.0)]
