"""Benchmark decontamination with spaced seeds.

A mask selects some of the token positions of a window and ignores the others, so a substituted word there changes nothing. Every
window of a benchmark item is hashed under every mask. Documents are hashed the same way; bitmaps of the benchmark's words and
hashes, of fixed size, discard nearly all windows inside the row, and only documents with windows that are left go on. Their windows join the
benchmark's hashes, each hit names a diagonal (where the item would begin in the document), and along the diagonal tokens are
compared one by one, together with the diagonals next to it, so that a word put in or left out does not end a stretch: the best stretch,
matches minus mismatches, decides. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Selected positions of each mask.
MASKS = ((0, 1, 2, 5, 7, 9), (0, 2, 3, 4, 8, 9), (0, 1, 4, 6, 7, 8))
#: Bits of the bitmaps of the benchmark's words and windows as powers of two, and how many places of the latter a hash has.
WORD_BITMAP_LOG2, SEED_BITMAP_LOG2, SEED_PROBES = 16, 20, 3
#: A document is contaminated by an item if the best stretch scores at least this share of the item's tokens or ENOUGH_TOKENS, whichever
#: is less, and LEAST_TOKENS.
LEAST_SHARE, LEAST_TOKENS, ENOUGH_TOKENS = 0.5, 8, 13
#: Diagonals on either side of a hit's that a stretch may go over to; each step costs as much as a mismatch.
BAND = 2


def _words(text: Column) -> Column:
    """Letters and digits in lower case, cut at all else."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _token_hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _windows(tokens: str, masks: tuple[tuple[int, ...], ...]) -> Column:
    """Structs of position and hash for each mask; windows with a null among their selected tokens are left out."""
    def under(m: int, mask: tuple[int, ...]) -> Column:
        whole = lambda i: reduce(and_, (F.get(F.col(tokens), i + o).isNotNull() for o in mask))
        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - (mask[-1] + 1)), whole)
        found = F.transform(places, lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.lit(m), *(F.get(F.col(tokens), i + o) for o in mask)).alias("seed")))
        return F.when(F.size(tokens) > mask[-1], found).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))
    return F.concat(*(under(m, mask) for m, mask in enumerate(masks)))


def _probe(value: Column, log2: int, k: int) -> Column:
    return F.shiftrightunsigned(value, log2 * k).bitwiseAND(F.lit((1 << log2) - 1).cast("long"))


def _bitmap(values: DataFrame, log2: int, probes: int) -> Callable[[Column], Column]:
    """A test by a bitmap of 2 ** log2 bits, which the driver sees and plans hold as a constant: no value of the table fails it."""
    name = values.columns[0]
    bits = values.select(F.explode(F.array(*(_probe(F.col(name), log2, k) for k in range(probes)))).alias("bit"))
    words = {r.word: r.bits for r in bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()}
    text = ",".join(str(words.get(i, 0)) for i in range(1 << (log2 - 6)))
    constant = F.split(F.lit(text), ",").cast("array<bigint>")

    def at(place: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        return F.get(constant, F.shiftright(place, 6).cast("int")).bitwiseAND(bit) != 0

    return lambda v: F.forall(F.array(*(_probe(v, log2, k) for k in range(probes))), at) if probes > 1 else at(_probe(v, log2, 0))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 masks: tuple[tuple[int, ...], ...] = MASKS, least_share: float = LEAST_SHARE, least_tokens: int = LEAST_TOKENS,
                 enough_tokens: int = ENOUGH_TOKENS, by_text: bool = False) -> DataFrame:
    """``doc_id, item_id, score, item_tokens, begins``: one row per document and benchmark item found in it, no others.

    ``score`` is the best stretch's matches minus mismatches and minus words put in or left out, ``begins`` the token of the document where the item would begin on
    that diagonal (it may be negative if only the item's end is there). Null texts are empty. Items with fewer tokens than a mask spans cannot be found. Rows
    that share an identifier count as one document; ``by_text`` tells their texts apart in a column ``body`` (Spark's xxhash64 of the text). Null
    identifiers are kept. An empty table gives an empty result.
    """
    items = cut(benchmark.select(F.col(item).alias("item_id"), _token_hashes(F.col(item_text)).alias("tokens")))
    seeds = cut(items.select("item_id", F.inline(_windows("tokens", masks))).distinct())
    word_of_item = _bitmap(items.select(F.explode("tokens").alias("token")).distinct(), WORD_BITMAP_LOG2, 1)
    seed_of_item = _bitmap(seeds.select("seed"), SEED_BITMAP_LOG2, SEED_PROBES)
    # words that no item has become null; only windows without any are hashed at all. A row goes on only if windows are
    # left; an explode of one struct keeps that test after the windows instead of repeating them
    left = (
        docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), _token_hashes(F.col(text)).alias("tokens"))
        .select("doc_id", "body", "tokens", F.transform("tokens", lambda h: F.when(word_of_item(h), h)).alias("shared"))
        .select("doc_id", "body", "tokens", F.filter(_windows("shared", masks), lambda w: seed_of_item(w["seed"])).alias("windows"))
        .select("doc_id", "body", F.inline(F.when(F.size("windows") > 0, F.array(F.struct("tokens", "windows")))))
    )
    left = cut(left)
    hits = (
        left.select("doc_id", "body", F.explode("windows").alias("w")).select("doc_id", "body", F.col("w.at").alias("there"), "w.seed")
        .join(seeds, "seed")
        .select("doc_id", "body", "item_id", (F.col("there") - F.col("at")).alias("begins")).distinct()
    )
    paired = (
        hits.join(items.withColumnRenamed("tokens", "wanted"), "item_id")
        .join(left.select(F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), "tokens").dropDuplicates(["_doc", "_body"]),
              F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body")))
    )
    # by diagonal of the band: what a stretch that ends at this token of the item scores there
    band = range(2 * BAND + 1)
    equal = F.transform("wanted", lambda x, i: F.array(*(
        F.when((F.col("begins") + i + d - BAND >= 0) & (F.get(F.col("tokens"), F.col("begins") + i + d - BAND) == x), F.lit(1)).otherwise(F.lit(-1)) for d in band)))

    def longer(a: Column, e: Column) -> Column:
        now = [F.greatest(F.lit(0), F.greatest(*(a["now"][c] - abs(c - d) for c in band)) + e[d]) for d in band]
        own = F.greatest(F.lit(0), a["own"] + e[BAND])
        return F.struct(F.array(*now).alias("now"), F.greatest(a["best"], *now).alias("best"), own.alias("own"), F.greatest(a["best_own"], own).alias("best_own"))

    start = F.struct(F.array(*(F.lit(0) for _ in band)).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("own"), F.lit(0).alias("best_own"))
    score = F.aggregate(equal, start, longer, lambda a: F.struct(a["best"].alias("score"), a["best_own"].alias("own")))
    names = ["doc_id", "body"] if by_text else ["doc_id"]
    scored = paired.select(*names, "item_id", "begins", F.size("wanted").alias("item_tokens"), score.alias("s")).select(
        *names, "item_id", "begins", "item_tokens", "s.score", "s.own")
    least = F.greatest(F.lit(float(least_tokens)), F.least(F.lit(float(enough_tokens)), least_share * F.col("item_tokens")))
    return (
        scored.filter(F.col("score") >= least)
        .groupBy(*names, "item_id")
        .agg(F.max(F.struct("score", "own", (-F.col("begins")).alias("place"), "item_tokens")).alias("b"))
        .select(*names, "item_id", "b.score", "b.item_tokens", (-F.col("b.place")).alias("begins"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those in whose text a benchmark item was found; other rows of the same identifier stay."""
    found = contaminated(docs, benchmark, key, text, by_text=True).select(F.col("doc_id").alias("_found"), F.col("body").alias("_body")).distinct()
    same = docs[key].eqNullSafe(found["_found"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found["_body"])
    return docs.join(found, same, "left_anti")
