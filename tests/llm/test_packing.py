import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoplex.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", None, " ", "\n", "don't stop.", "<|endoftext|>a<|ENDOFTEXT|>.", "a,b..c!?", "É́x é. ß!  y z.", "it's. 'S 's.", "x<y.", "ﬁ.", "...", "日本語。 テスト.", "A\u0301.",
        "İ. I.", "1.", "a1.2.", "\u212a. Å.", "word\x1fx", "zero\u200bwidth.", "٣.", "don'T.", "e\u0301.", "\u3000wide", "end\u00a0nbsp.", "A.B.C", "?!", " lead", "trail "]


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 5, 16, 50, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    runs, sequences = K.plan_runs(counts, capacity)
    assert sequences == best_fit_decreasing(lengths, capacity)
    placed, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, first, offset in runs.tolist():
        ranks[length] += range(rank, rank + count)
        for i in range(count):
            placed[first + i].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_ids_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = HARD + ["".join(rng.choices("aB'é. ,<|>1\n\u0301", k=rng.randint(0, 30))) for _ in range(600)]
    ids, counts = K.token_ids(pa.array(texts), PATH, 1)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at: at + n].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [1], text
        at += n


def test_pack(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(["the", "of", "wonderful", "Zürich."], k=rng.choice([0, 3, 20, 90, 700])))) for i in range(120)] + [(5, None), (5, None), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, part int").repartition(5)
    got = K.pack(docs, PATH, capacity=256).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 256)):
            piece = np.array(ids[at: at + 256], dtype="<u4").tobytes()
            want.append((i, p, at, len(piece) // 4, zlib.crc32(piece), piece))
    assert sorted((tuple(r)[:5] + (bytes(r.ids),) for r in got), key=str) == sorted(want, key=str)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) == best_fit_decreasing([w[3] for w in want], 256)
    assert K.pack(docs.limit(0), PATH).collect() == []
