"""Line dedup across documents.

The lines of all documents become rows of (128-bit key hash, document, position). Hashes are range-partitioned and sorted by document
and position inside each partition, so the first occurrence of a line streams past first and its document is known
when the others follow. A line that very many documents share would be one huge range: such hashes show up
in a sample of the rows and are settled by an aggregate that is combined before the shuffle. The sample only decides
which way a hash takes; both ways are exact. What comes back per document is a bitmap of 64-bit words, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .text import WHITE, ascii_lower

#: Rows looked at to find lines that fill a task alone, and the share of them from which a line counts as such.
SAMPLE_ROWS, HOT_SHARE = 200_000, 1 / 1000


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10) -> DataFrame:
    """``doc, body, n_dropped, words``: the lines to drop, for documents that lose any.

    ``body`` is a hash of the text, which tells rows apart that share an identifier. Bit p % 64 of element p // 64 of
    ``words`` is set if line p goes; trailing zero words are left out.
    """
    keys = F.transform(_lines(F.col(text)), line_key)
    hashed = F.transform(keys, lambda k: F.struct(
        F.length(k).alias("n"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(17), k).alias("h2")))
    lines = cut(
        docs.select(F.col(key).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.posexplode(hashed).alias("pos", "line"))
        .filter(F.col("line.n") >= least_chars)
        .select("doc", "body", "pos", "line.h1", "line.h2")
    )
    rows = lines.count()
    seen = lines.sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=7).groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
    # at most 1 / HOT_SHARE hashes can have such a share
    hot = [r.h1 for r in seen.filter(F.col("n") >= max(16, HOT_SHARE * min(rows, SAMPLE_ROWS))).select("h1").collect()]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)

    by_place = Window.partitionBy("h1", "h2").orderBy(F.col("doc").asc_nulls_first(), "body", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ordinary = (
        lines.filter(~is_hot).repartitionByRange("h1", "h2")
        .sortWithinPartitions("h1", "h2", F.col("doc").asc_nulls_first(), "body", "pos")
        .withColumn("first", F.first("doc").over(by_place))
        .filter(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "body", "pos")
    )
    # a struct with a null compares as the smallest, as the sort above has it
    firsts = lines.filter(is_hot).groupBy("h1", "h2").agg(F.min(F.struct("doc")).alias("lowest"))
    frequent = (
        lines.filter(is_hot).join(F.broadcast(firsts), ["h1", "h2"])  # a row per hot hash
        .filter(~F.col("doc").eqNullSafe(F.col("lowest.doc"))).select("doc", "body", "pos")
    )
    dropped = ordinary.unionByName(frequent)
    return (
        dropped.groupBy("doc", "body", F.shiftright("pos", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
        .groupBy("doc", "body")
        .agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("sparse"))
        .select("doc", "body", "n_dropped", F.transform(
            F.sequence(F.lit(0), F.element_at("sparse", -1)["at"]),
            lambda w: F.coalesce(F.get(F.col("sparse.bits"), (F.array_position(F.col("sparse.at"), w) - 1).cast("int")), F.lit(0).cast("long"))).alias("words"))
    )


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, drop_words, kept_text``: one row per row of ``docs``.

    Lines end at ``\\n``; a null or empty text is one empty line. Keys (:func:`line_key`) of at least ``least_chars`` code points
    that two documents or more hold lose their lines in all but the smallest identifier; repeats inside that one stay.
    Rows with one identifier count as one document; a null identifier is one too and comes before all others. Kept lines
    are joined by ``\\n``; if none stays the text is empty. ``drop_words`` is null where nothing goes.
    """
    maps = drop_bitmaps(docs, key, text, least_chars).hint("shuffle_hash")
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_body", F.xxhash64("text"))
    joined = whole.join(maps, whole["doc_id"].eqNullSafe(maps["doc"]) & (whole["_body"] == maps["body"]), "left")
    lines = _lines(F.col("text"))
    stays = lambda x, i: (F.coalesce(F.get(F.col("words"), F.shiftright(i, 6)), F.lit(0).cast("long")).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)))) == 0)
    kept = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return joined.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.col("words").alias("drop_words"), kept.alias("kept_text"))
