"""Exact links between similar sets that meet in a group, by set-relation skipping.

A group says that its sets may be similar; which of them are is decided here from the whole sets. Large groups are dealt out in blocks.
Inside a block, sets are ordered by size and tokens by their frequency in the block. The index lists of the sets' prefixes are cut into
skip blocks, runs of one set size and one position, and a skip block is left out as a whole where its size and position rule out the
similarity. A set's intersection sizes come from those of a highly similar set, if there is one: only the lists of tokens in which the two
sets differ are counted and added or taken away.

Results are links that span what is similar: sets that links already connect are not compared again. Groups of more than one block take a second
round, in which every set outside the group's largest component meets the sets of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import weak_components
from ..plans.lineage import cut

#: Sets and tokens of a block.
BLOCK_SETS, BLOCK_TOKENS = 2048, 500_000
#: Sets of a block whose intersection sizes are kept to derive others from.
KEPT_ANSWERS = 32


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, last), and which range each is of."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


class Index:
    """Sets of one block, ordered by size, with index lists over their tokens; similar means intersection / union >= similarity."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, similarity: Fraction):
        self.num, self.den = similarity.numerator, similarity.denominator
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.starts = self.ends - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        _, local, df = np.unique(tokens, return_inverse=True, return_counts=True)
        place = np.empty(len(df), dtype=np.int64)
        place[np.argsort(df, kind="stable")] = np.arange(len(df))
        rank = place[local]
        order = np.lexsort((rank, owner))
        self.rank = rank[order]
        shared = np.sort(df)[self.rank] > 1
        self.prefix = sizes - -(-self.num * sizes // self.den) + 1
        position = np.arange(len(owner)) - self.starts[owner]
        # whole lists, for counting
        at = np.flatnonzero(shared)
        at = at[np.argsort(self.rank[at], kind="stable")]
        self.list_owner = owner[at]
        self.list_first = np.searchsorted(self.rank[at], np.arange(len(df) + 1))
        # lists of the prefixes, in skip blocks
        at = np.flatnonzero(shared & (position < self.prefix[owner]))
        at = at[np.lexsort((position[at], sizes[owner[at]], self.rank[at]))]
        key = np.stack([self.rank[at], sizes[owner[at]], position[at]])
        new = np.ones(len(at), dtype=bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        self.entry = owner[at]
        self.block_first = np.append(np.flatnonzero(new), len(at))
        token, self.block_size, self.block_position = key[:, new]
        self.token_block = np.searchsorted(token, np.arange(len(df) + 1))
        self.kept: list[tuple[int, np.ndarray]] = []

    def tokens(self, x: int) -> np.ndarray:
        return self.rank[self.starts[x]: self.ends[x]]

    def candidates(self, x: int) -> np.ndarray:
        """Sets that share a prefix token with x in a skip block that allows the similarity."""
        n = self.sizes[x]
        probe = self.tokens(x)[: self.prefix[x]]
        block, i = _ranges(self.token_block[probe], self.token_block[probe + 1])
        m = self.block_size[block]
        left = np.minimum(n - i, m - self.block_position[block])  # tokens from here on
        block = block[((self.num + self.den) * left >= self.num * (n + m)) & (self.den * np.minimum(n, m) >= self.num * np.maximum(n, m))]
        return np.unique(self.entry[_ranges(self.block_first[block], self.block_first[block + 1])[0]])

    def _counted(self, tokens: np.ndarray) -> np.ndarray:
        return np.bincount(self.list_owner[_ranges(self.list_first[tokens], self.list_first[tokens + 1])[0]], minlength=len(self.sizes))

    def _length(self, tokens: np.ndarray) -> int:
        return int((self.list_first[tokens + 1] - self.list_first[tokens]).sum())

    def overlaps(self, x: int) -> np.ndarray:
        """Sizes of the intersections of x with all sets (tokens that no other set has left aside)."""
        mine, found = self.tokens(x), None
        if self.kept:
            y, answers = min(self.kept, key=lambda k: self.sizes[k[0]] - 2 * k[1][x])  # the least difference
            theirs = self.tokens(y)
            more, less = np.setdiff1d(mine, theirs, assume_unique=True), np.setdiff1d(theirs, mine, assume_unique=True)
            if self._length(more) + self._length(less) < self._length(mine):
                found = answers + self._counted(more) - self._counted(less)
        if found is None:
            found = self._counted(mine)
        self.kept = [*self.kept[-KEPT_ANSWERS + 1:], (x, found)]
        return found

    def links(self, label: np.ndarray, probing: np.ndarray) -> tuple[list[int], list[int]]:
        """Links that join sets of different labels; each has a probing set at its left end. ``label`` is changed."""
        left, right = [], []
        for x in np.flatnonzero(probing).tolist():
            near = self.candidates(x)
            near = near[label[near] != label[x]]
            if len(near):
                both = self.overlaps(x)[near]
                near = near[(self.num + self.den) * both >= self.num * (self.sizes[x] + self.sizes[near])]
                _, first = np.unique(label[near], return_index=True)
                for y in near[first].tolist():
                    left.append(x)
                    right.append(y)
                    label[label == label[y]] = label[x]
        return left, right


def _linker(similarity: Fraction):
    """Links of each block, from rows ``grp, part, key, label, probing, tokens`` with the rows of a block one after another."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        key, label = rows.column("key").to_numpy(), rows.column("label").to_numpy()
        probing = rows.column("probing").to_numpy()
        sets = rows.column("tokens").combine_chunks()
        offsets, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
        size = np.diff(offsets)
        order = np.lexsort((~probing, key, size))  # a set that is there twice counts once
        order = order[np.diff(key[order], prepend=key[order[0]] - 1) != 0]
        tokens = values[_ranges(offsets[order], offsets[order + 1])[0]]
        index = Index(tokens, size[order], similarity)
        left, right = index.links(np.unique(label[order], return_inverse=True)[1], probing[order])
        return pa.RecordBatch.from_arrays([pa.array(key[order[left]] if left else [], pa.int64()), pa.array(key[order[right]] if right else [], pa.int64())], names=["src", "dst"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grp, part = batch.column("grp").to_numpy(), batch.column("part").to_numpy()
            new = np.ones(len(grp), dtype=bool)
            new[1:] = (grp[1:] != grp[:-1]) | (part[1:] != part[:-1])
            if held and len(grp):
                new[0] = (held[-1].column("grp")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (grp[0], part[0])
            bounds = np.flatnonzero(new).tolist()
            for at, to in zip([0, *bounds] if not bounds or bounds[0] else bounds, [*bounds, batch.num_rows] if not bounds or bounds[0] else [*bounds[1:], batch.num_rows]):
                if new[at] and held:
                    yield found(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, to - at))
        if held:
            yield found(pa.Table.from_batches(held))

    return stream


def _linked(rows: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """``rows``: grp, part, key, label, probing."""
    whole = rows.join(sets.select("key", F.col("shingles").alias("tokens")), "key").select("grp", "part", "key", "label", "probing", "tokens")
    return cut(whole.repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(_linker(similarity), "src long, dst long"))


def _parts(sets: str, tokens: str):
    """Blocks for so many sets and tokens."""
    return F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(tokens) / BLOCK_TOKENS), F.lit(1)).cast("int")


def components_of(links: DataFrame) -> DataFrame:
    """``key, comp`` for all ends of the links ``src, dst``; ``comp`` is the smallest key that is reached."""
    found = weak_components(links.select(F.explode(F.array("src", "dst")).alias("uid")), links, edges_inside=True)
    return found.select(F.col("uid").alias("key"), "comp")


def links_in_groups(members: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """``src, dst``: links between keys that share a group and whose sets have the similarity.

    ``members``: grp, key, n (size of the set), one row per group and key; ``sets``: key, shingles (distinct), one row per key; groups, keys and shingles are
    long. Two similar sets that share a group are connected by the links, directly or over others; every link is a similar pair.
    """
    groups = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"), F.min("key").alias("pivot")).filter("m > 1").withColumn("parts", _parts("m", "t"))
    placed = cut(members.join(groups, "grp").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    # the pivot goes to every block, so that most blocks are connected in this round
    everywhere = F.when(F.col("key") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    first = _linked(placed.select("grp", F.explode(everywhere).alias("part"), "key", F.col("key").alias("label"), F.lit(True).alias("probing")), sets, similarity)
    large = placed.filter("parts > 1").select("grp", "key", "n", "part", "parts")
    if large.isEmpty():
        return first
    large = large.join(components_of(first), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    counted = large.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"))
    most = counted.groupBy("grp").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"))
    large = cut(large.join(most, "grp"))
    others = large.filter("comp <> most")
    chunks = others.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t")).select("grp", _parts("m", "t").alias("chunks"))
    salt = F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int")
    where = F.struct(F.col("chunk") * F.col("parts") + F.col("part"))
    left = others.join(chunks, "grp").withColumns({"chunk": salt, "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).withColumn("probing", F.lit(True))
    right = large.join(chunks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("probing", F.lit(False))
    pairs = left.select(*right.columns).unionByName(right).select("grp", (F.col("chunk") * F.col("parts") + F.col("part")).alias("part"), "key", F.col("comp").alias("label"), "probing")
    return first.unionByName(_linked(pairs, sets, similarity))
