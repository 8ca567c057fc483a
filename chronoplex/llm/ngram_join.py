"""N-gram Jaccard self-join: documents whose sets of word shingles are similar, and the components of these links.

Equal sets count once. Shingles have one order for all documents, rarest first as far as a count sketch over the whole table tells, ties by
hash. A set is posted under its prefix in this order, which is longer by a share of the set: two similar sets have several shingles of their
prefixes in common. Index lists are cut by size classes; a posting is skipped where its size and position rule out all that its list has in the classes around. The
smallest set of a list is its pivot, and sets meet in the groups of their pivots. A set leaves out the pivots that it shares least with, as long as they
hold less than half of the shingles that it needs in common with another set, so two similar sets always keep a pivot in common. ``set_links`` decides in
each group from the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .near_copies import document_sets, lists_of, set_key, sets_of
from .set_links import components_of, links_in_groups

#: Counters of the sketch: shingles are counted by the upper bits of their hashes. One byte a counter goes to the workers.
COUNTER_BITS = 20
#: Sketches that one task adds up.
FAN_IN = 16
#: A prefix is longer by one shingle for so many shingles of the set, and as many more are in common.
MORE_EACH = 30


def shingle_counts(docs: DataFrame, words_per_shingle: int) -> np.ndarray:
    """How many documents have a shingle with these upper bits: ``2 ** COUNTER_BITS`` numbers, whatever the size of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            for _, sets in document_sets(words_per_shingle, batch):
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["counts"])

    sketches = cut(docs.select("text").mapInArrow(count, "counts binary"))
    left = sketches.count()
    while left > 1:
        left = -(-left // FAN_IN)
        sketches = sketches.repartition(left).mapInArrow(add, "counts binary")
    row = sketches.first()
    return np.frombuffer(row[0], dtype=np.int64) if row else np.zeros(1 << COUNTER_BITS, dtype=np.int64)


def _prints(words_per_shingle: int, similarity: Fraction, classes: np.ndarray):
    num, den = similarity.numerator, similarity.denominator

    def prefix(tokens: np.ndarray) -> np.ndarray:
        order = np.lexsort((tokens, classes[tokens >> np.uint64(64 - COUNTER_BITS)]))
        return tokens[order[: len(tokens) + -num * len(tokens) // den + 1 + len(tokens) // MORE_EACH]] if len(tokens) else tokens

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, sets in document_sets(words_per_shingle, batch):
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()),
                     lists_of([prefix(s) for s in sets])], names=["doc_id", "text_hash", "n", "key", "prefix"])
    return stream


def _at_least(n: Column, num: int, den: int) -> Column:
    """The least size of a set that is similar to one of size n."""
    return F.ceil(n * num / F.lit(den))


def _members(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """``grp, key, n``: the groups in which a set can meet similar ones."""
    n, i = F.col("n"), F.col("i")
    # two sizes that allow the similarity are of one class or of neighbouring ones
    size_class = F.floor(F.log(n) / float(np.log(den / num)) + 1e-9).cast("int")
    tokens = nodes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token")
    # most shingles are one set's own: they go before anything else is gathered about them
    posted = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "token")).join(tokens, "token", "left_semi")
    posted = cut(posted.withColumn("class", size_class))
    whole = Window.partitionBy("token")
    along = whole.orderBy("class")
    near = lambda name, step: F.when(F.lag("class", step).over(along) == F.col("class") - step, F.lag(name, step).over(along))
    lists = (
        posted.groupBy("token", "class").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("node").alias("low"))
        .withColumns({"grp": F.min("low").over(whole), "below": near("most", 1), "above": near("least", -1)})
        .select("token", "class", "m", "least", "below", "above", "grp")
    )
    # the first shingles in common: at position i, so many of the set can be in common at most; a set of that size needs share * (n + size) of them
    possible = (num + den) * (n - i + F.floor(n / MORE_EACH))
    fits = lambda size: F.coalesce((possible >= num * (n + size)) & (F.least(n, size) * den >= F.greatest(n, size) * num), F.lit(False))
    alone = (F.col("m") > 1) & (possible >= num * (n + F.greatest(F.col("least"), _at_least(n, num, den))))
    below = F.coalesce((F.col("below") * den >= n * num) & (possible >= num * (n + _at_least(n, num, den))), F.lit(False))
    shared = posted.join(lists, ["token", "class"]).filter(alone | below | fits(F.col("above"))).groupBy("node", "grp").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c"))
    needed = 1 + F.floor(_at_least(n, num, den) / MORE_EACH)
    own = Window.partitionBy("node")
    rising = own.orderBy("c", "grp").rowsBetween(Window.unboundedPreceding, 0)
    counted = shared.withColumns({"_all": F.sum("c").over(own), "_up_to": F.sum("c").over(rising)})
    kept = counted.filter((F.col("_all") >= needed) & (2 * F.col("_up_to") > needed - 1)).select("grp", "node", "n")
    return kept.join(nodes.select("node", "key"), "node").select("grp", "key", "n")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 4, similarity: Fraction = Fraction(85, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``.

    A-Z are lower-cased; words are runs of other than ASCII white space. A text with fewer words than a shingle has is one shingle; a null text counts as
    empty. Texts link when intersection / union of their sets is at least ``similarity``; texts without words have no shingles and link with nothing.
    ``component_id`` is the smallest identifier that links reach, the row's own included; rows with a null identifier take part and
    get the component's, null if it has none. Rows that repeat, or share an identifier, stay rows of their own. Other columns are not read. An empty table
    gives an empty result. Shingles and sets are known by 64-bit hashes.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    counts = shingle_counts(rows, words_per_shingle)
    classes = np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)
    prints = cut(rows.mapInArrow(_prints(words_per_shingle, similarity, classes), "doc_id long, text_hash long, n long, key long, prefix array<long>"))
    # one row per set: copies go before anything is posted
    nodes = cut(prints.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.max("n").alias("n"), F.first("prefix").alias("prefix"))
                .withColumn("node", F.monotonically_increasing_id()))
    num, den = similarity.numerator, similarity.denominator
    members = cut(_members(nodes, num, den))
    # members of a group of one have no one to meet
    met = members.join(members.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("grp"), "grp", "left_semi")
    sets = sets_of(rows, nodes.join(met.select("key").distinct(), "key", "left_semi"), words_per_shingle)
    links = links_in_groups(met, sets, similarity)
    placed = nodes.select("key", "low").join(components_of(links), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    named = placed.join(placed.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("key", "component_id")
    found = prints.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key"))
    # a text without shingles is a component of its own
    return found.join(named, "key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
