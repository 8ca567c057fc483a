"""Exact dedup by sorting contents.

Rows are dealt out by ranges of (first bytes, hash, identifier), with splitters that Spark samples; the key is short, so
the sample stays small however long the texts are. Inside a partition an external sort puts equal texts next to
each other and neighbours are compared in full. The identifier in the key lets copies of one text go over several
partitions: a text that a third of all rows share is no single task. Only the first and the last run of a partition
can go on elsewhere; they are joined by their whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Characters of a text that take part in the range key.
HEAD = 32

_STAGED = "doc_id long, text_sha256 string, keeper boolean, run_keep long, run_size long, part int, edge int, edge_text string"


def _runs(largest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Find runs of equal texts in sorted rows. ``edge`` is 0 for the partition's first run and 1 for its last one."""
    none = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max

    def rows(text: pa.Scalar, ids: np.ndarray, part: int, edge: int | None) -> pa.RecordBatch:
        n = len(ids)
        keep = int(ids.max() if largest else ids.min())
        first = np.zeros(n, dtype=bool)
        first[int(np.argmax(ids == keep))] = True
        whole = [None] * n
        if edge is not None:
            whole[0] = text.as_py()
        null = ids == none
        return pa.RecordBatch.from_arrays([
            pa.array(ids, mask=null), pa.array([hashlib.sha256(text.as_buffer()).hexdigest()] * n), pa.array(first),
            pa.array(np.full(n, keep), mask=np.full(n, keep == none)), pa.array(np.full(n, n, dtype=np.int64)),
            pa.array(np.full(n, part, dtype=np.int32)), pa.array([edge] * n, type=pa.int32()), pa.array(whole, type=pa.string()),
        ], names=["doc_id", "text_sha256", "keeper", "run_keep", "run_size", "part", "edge", "edge_text"])

    def singles(texts: pa.Array, ids: np.ndarray, part: int) -> pa.RecordBatch:
        """Runs of one row, all at once."""
        n, null = len(ids), ids == none
        return pa.RecordBatch.from_arrays([
            pa.array(ids, mask=null), pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]),
            pa.array(np.ones(n, dtype=bool)), pa.array(ids, mask=null), pa.array(np.ones(n, dtype=np.int64)),
            pa.array(np.full(n, part, dtype=np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()),
        ], names=["doc_id", "text_sha256", "keeper", "run_keep", "run_size", "part", "edge", "edge_text"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        text, ids, seen = None, [], 0  # the open run and how many runs have ended
        for batch in batches:
            texts, now = batch.column("text"), batch.column("doc_id").fill_null(none).to_numpy(zero_copy_only=False)
            if not len(now):
                continue
            fresh = np.ones(len(now), dtype=bool)
            fresh[0] = text is None or not texts[0].as_buffer().equals(text.as_buffer())
            fresh[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(fresh)
            if not len(starts):
                ids.append(now)
                continue
            if text is not None:
                ids.append(now[: starts[0]])
                yield rows(text, np.concatenate(ids), part, 0 if not seen else None)
                seen += 1
            ends = np.append(starts[1:], len(now))
            alone = []
            for a, b in zip(starts[:-1], ends[:-1]):
                if not seen:
                    yield rows(texts[int(a)], now[a:b], part, 0)
                elif b - a == 1:
                    alone.append(a)
                else:
                    yield rows(texts[int(a)], now[a:b], part, None)
                seen += 1
            if alone:
                yield singles(texts.take(pa.array(alone)), now[alone], part)
            text, ids = pa.scalar(texts[int(starts[-1])].as_py(), type=texts.type), [now[starts[-1]:]]
        if text is not None:
            yield rows(text, np.concatenate(ids), part, 1 if seen else 0)

    return stream


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest",
                normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``, dropped ones too.

    A null text counts as empty. ``normalize`` maps a text before comparison (default: none). Of equal texts the row with the
    smallest (or ``largest``) identifier is kept. Null identifiers come last in that choice: ``keep_id`` is null only
    if a whole group has none. Of rows that repeat both identifier and text exactly one is kept. Other columns
    are not looked at, whatever their names. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    body = F.coalesce(F.col(text), F.lit(""))
    body = normalize(body) if normalize else body
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text")).select(
        F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"), "doc_id", "text")
    order = ["head", "hash", "text", "doc_id"]
    dealt = rows.repartitionByRange("head", "hash", "doc_id").sortWithinPartitions(*order)
    staged = cut(dealt.select("doc_id", "text").mapInArrow(_runs(keep == "largest"), _STAGED))
    inner = staged.filter(F.col("edge").isNull()).select(
        "doc_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("keeper").alias("kept"), "text_sha256")
    # two rows per partition at most
    same = Window.partitionBy("edge_text")
    best = (F.max if keep == "largest" else F.min)("run_keep").over(same)
    edges = (
        staged.filter(F.col("edge_text").isNotNull())
        .select("part", "edge", "edge_text", "run_keep", best.alias("keep_id"), F.sum("run_size").over(same).alias("group_size"))
        .withColumn("keep_part", F.min(F.when(F.col("run_keep").eqNullSafe(F.col("keep_id")), F.col("part") * 2 + F.col("edge"))).over(same))
        .select("part", "edge", "keep_id", "group_size", (F.col("part") * 2 + F.col("edge") == F.col("keep_part")).alias("keeps"))
    )
    outer = staged.filter(F.col("edge").isNotNull()).join(edges, ["part", "edge"]).select(
        "doc_id", "keep_id", "group_size", (F.col("keeper") & F.col("keeps")).alias("kept"), "text_sha256")
    return inner.unionByName(outer)


def kept_documents(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each kept row of ``decided`` (made by :func:`exact_dedup` without ``normalize``), with all columns."""
    kept = decided.filter("kept").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_digest"))
    rows = docs.withColumn("_own", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    found = rows.join(kept, F.col(key).eqNullSafe(F.col("_kept")) & (F.col("_own") == F.col("_digest")), "left_semi")
    return found.dropDuplicates([key, "_own"]).select(*docs.columns)
