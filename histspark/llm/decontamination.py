"""Benchmark decontamination by spaced seeds that no allowed substitution escapes.

An overlap counts when some stretch of ``min(item words, span)`` words agrees in at least ``share`` of its words, so at most
k of its words differ. Words are dealt to k + 2 classes by their place modulo k + 2: the k words spoil at most k classes, so
two are clean. A fixed mask keeps the places of two classes and ignores all others; since the classes of a stretch may lie
anywhere, k + 1 masks (one for each distance of two classes) do for all pairs. At 20 words that is five masks of six words,
spread over up to 18; where no word may differ the mask is the whole stretch. Seeds of benchmark items are joined with seeds
at every word position of every document; around each hit the item is laid on the document along the hit's diagonal and
compared word by word.

Native: words, seeds, join and verification are DataFrame functions. A seed row is lean (class, place, seed). Where all
seeds and items together are under a bound in bytes they are sent to the documents, whose word hashes stay where they are;
only hits carry a slice of them, no longer than the item, and equal ones become one where they are found, so a document of
very many hits takes no more memory than its distinct diagonals. Beyond the bound both sides shuffle on the seed, with no words beside it, and the distinct
diagonals return to the documents that have any.

Defined results: null and empty texts have no words and hit nothing; rows repeated whole give one result; items of equal
words share one comparison and are all reported; items of one word up are compared by the same rule; an empty table gives
no rows; extra columns are ignored by ``overlaps`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored, text_of, tune

#: Words of the stretch that must agree, and the share of them.
SPAN, SHARE = 20, 0.8
#: Bytes of benchmark seeds and word hashes that are sent to every task at most; more are joined by shuffle.
SENT_BYTES = 64 << 20
#: What a seed row takes, and a word hash.
_SEED_BYTES, _WORD_BYTES = 48, 8

_WORD = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words of a text."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))


def masks(width: int, share: float) -> list[tuple[int, ...]]:
    """Masks (kept places, from 0) one of which, laid somewhere on a stretch of ``width`` words, meets no differing word
    wherever at least ``share`` of them agree."""
    agree = next(a for a in range(width + 1) if a / width >= share)
    classes = width - agree + 2
    if agree == width:
        return [tuple(range(width))]
    if agree < 2:
        return [(0,)]
    rounds = width // classes
    if not rounds:  # any two agreeing places
        return [(0, d) for d in range(1, width)]
    return [tuple(sorted(r * classes + e for r in range(rounds) for e in (0, d))) for d in range(1, classes)]


def _seed(h: Column, at: Column, mask: tuple[int, ...]) -> Column:
    """The seed of a mask at a position; null where the mask leaves the text."""
    return F.when(at + mask[-1] < F.size(h), F.xxhash64(F.lit(",".join(map(str, mask))), *[F.get(h, at + o) for o in mask]))


def seed_table(benchmark: DataFrame, span: int = SPAN, share: float = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cls, n, width, ipos, seed) of distinct items, (cls, ih) their word hashes, and (cls, item_id)."""
    named = benchmark.select("item_id", word_hashes(text_of()).alias("ih")).where(F.size("ih") > 0).withColumn("cls", F.xxhash64("ih"))
    items = named.groupBy("cls").agg(F.first("ih").alias("ih"))
    width = F.least(F.size("ih"), F.lit(span))
    at = items.select("cls", F.size("ih").alias("n"), width.alias("width"), "ih", F.posexplode("ih").alias("ipos", "_w"))
    own = [F.when(F.col("width") == w, F.array(*[_seed(F.col("ih"), F.col("ipos"), m) for m in masks(w, share)])) for w in range(1, span + 1)]
    seeds = at.select("cls", "n", "width", "ipos", F.explode(F.coalesce(*own)).alias("seed")).where("seed is not null").distinct()
    return seeds, items, named.select("cls", "item_id")


def _beside(h: Column, diagonal: Column, n: Column) -> Column:
    """The document's words beside an item's, as far as there are any: from item place 0, or from -diagonal below 0."""
    return F.slice(h, F.greatest(diagonal, F.lit(0)) + 1, n + F.least(diagonal, F.lit(0)))


def _agreeing(ih: Column, part: Column, diagonal: Column, span: int) -> Column:
    """Largest share of agreeing words in a stretch of the item, ``part`` being the document's words beside it."""
    same = F.transform(F.sequence(F.lit(0), F.size(ih) - 1), lambda i: F.get(part, i + F.least(diagonal, F.lit(0))).eqNullSafe(F.get(ih, i)).cast("int"))
    width = F.least(F.size(ih), F.lit(span))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(ih) - width), lambda j: F.aggregate(F.slice(same, j + 1, width), F.lit(0), lambda a, x: a + x))) / width


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, share: float = SHARE, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, agreeing share of every overlap, best diagonal of each pair, with row keys."""
    tune(docs.sparkSession)
    seeds, items, named = seed_table(benchmark, span, share)
    seeds, items = stored(seeds, "benchmark-seeds"), stored(items, "benchmark-items")
    # at most one row for each stretch length
    counts = {r["width"]: r["count"] for r in seeds.groupBy("width").count().collect()}
    words_there = items.agg(F.sum(F.size("ih"))).first()[0] or 0
    sent = sum(counts.values()) * _SEED_BYTES + words_there * _WORD_BYTES <= sent_bytes
    shapes = sorted({m for w in counts for m in masks(w, share)}) or [(0,)]
    k1, k2 = row_key()
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1, k2, word_hashes(text_of()).alias("h"))
    grams = words.select("doc_id", "_k1", "_k2", "h", F.posexplode("h").alias("pos", "_w"))
    grams = grams.select("doc_id", "_k1", "_k2", "h", "pos", F.explode(F.array(*[_seed(F.col("h"), F.col("pos"), m) for m in shapes])).alias("seed")).where("seed is not null")
    diagonal = (F.col("pos") - F.col("ipos")).alias("diagonal")
    pair = ["_k1", "_k2", "cls", "diagonal"]
    if sent:  # what is selected here has to compile, with the distinct behind it: else all hits of a document are held with its words
        hits = grams.join(F.broadcast(seeds.drop("width")), "seed").select("doc_id", "_k1", "_k2", "cls", diagonal, _beside(F.col("h"), F.col("pos") - F.col("ipos"), F.col("n")).alias("part"))
        laid = hits.distinct()
    else:
        hits = grams.select("_k1", "_k2", "pos", "seed").join(seeds.drop("width"), "seed").select("_k1", "_k2", "cls", "n", diagonal).distinct()
        once = words.dropDuplicates(["_k1", "_k2"])
        laid = hits.join(once, ["_k1", "_k2"]).select("doc_id", *pair, _beside(F.col("h"), F.col("diagonal"), F.col("n")).alias("part"))
    verified = laid.join(F.broadcast(items) if sent else items, "cls").select("doc_id", *pair, F.size("ih").alias("n"), _agreeing(F.col("ih"), F.col("part"), F.col("diagonal"), span).alias("agree")).where(F.col("agree") >= share)
    top = verified.groupBy("_k1", "_k2", "cls").agg(F.max_by(F.struct("doc_id", "diagonal", "n", "agree"), F.struct("agree", -F.col("diagonal"))).alias("b"))
    return top.join(named, "cls").select("b.doc_id", "item_id", F.greatest(F.col("b.diagonal"), F.lit(0)).cast("long").alias("first_word"), F.col("b.n").cast("long").alias("n_words"), F.col("b.agree").alias("agree"), "_k1", "_k2")


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without any overlap, all columns kept."""
    found = stored(overlaps(docs, benchmark, span, share).select("_k1", "_k2").distinct(), "contaminated")
    k1, k2 = row_key()
    kept = docs.select(F.struct("*").alias("row"), k1, k2).join(found, ["_k1", "_k2"], "left_anti")
    return kept.select("row.*")


def query(spark, sf_dir):
    """op7: overlaps of all ``documents`` with all ``benchmark`` items."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return overlaps(docs, bench).drop("_k1", "_k2")
