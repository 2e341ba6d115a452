"""Language-model scores by a probabilistic suffix tree over bytes.

Training texts are lower-cased (A-Z) and cut into words; a text's symbols are the bytes of its words with a space
behind each and a newline at its end. Whole-corpus counts of (context, next byte) are summed by Spark at full depth and
rolled up to shorter contexts. A context is retained when it is frequent enough and its next-byte distribution diverges
from its parent's; suffixes of retained contexts are retained. Distributions are smoothed by mixing each with its
parent's (Witten and Bell). A byte is scored by the longest retained suffix of what precedes it. A token's probability
is the product over its bytes, smoothed at word level: where a token begins, the state "word" knows whole tokens by their
share of all training tokens, and is mixed with what the byte states spell. Both give all tokens together one (a token
never seen has no share and is only spelled), so the score is the log10 probability of the text, and the probabilities of
all texts sum to one. The base estimate takes no part in it.

Retained contexts and entries cover at least a fixed share of the training bytes, so at most 1/share of them exist at
each depth however large the corpus; that bound makes the model fit for sending to every task. Corpus counts themselves
are complete and stay distributed.

Base and score need the exact count of every word. Words above a fixed share of all tokens (boundedly many) are scored in the
tasks; the others, none of which is frequent, are joined with the count table.

Defined results: null text is the empty text (one token, the end); rows repeated whole are scored each; without training
rows the counts are empty and the root is uniform; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, byte_chunks, crc_mod, stored, text_of, tune
from .suffix_tree import CONTEXT_SHARE, DEPTH, ENTRY_SHARE, GAIN, ROOT_PRIOR, SuffixTree, keys_of, mask

#: Words of at least this share of all training tokens are counted in the tasks; there are at most 1/share.
COMMON_SHARE = 1e-6
#: Weight of the bytes' states in a token's probability; the token's share of the training tokens has the rest.
TREE_WEIGHT = 0.5
#: Bytes of text that are turned to keys at once, texts of a batch (about as many bytes: the more texts, the fewer of their
#: keys differ), and keys merged at once.
CHUNK, TEXTS, MERGE = 4 << 20, 1250, 3_000_000
#: Name of the end token in the word counts; no word is empty.
END = ""

_COUNTS = "word string, gram long, n long"
_PARTIAL = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,tree:double>>"


def words_of(text: str) -> list[bytes]:
    """Words of a text: runs of anything but ASCII white space, A-Z lowered."""
    return text.encode("utf-8", "replace").lower().split()


def spelled(words: list[bytes]) -> bytes:
    """The symbols of a text: each word with a space behind, then a newline."""
    return b" ".join(words) + b" \n" if words else b"\n"


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Summed counts of distinct keys; the list is emptied, so that its arrays do not stay beside their copies."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counts(train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Word counts (gram null) and (context, byte) counts (word null) of each task's texts; sums are the caller's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush_words() -> Iterator[pa.RecordBatch]:
            items = list(words.items())
            words.clear()
            for at in range(0, len(items), 20_000):
                part = items[at : at + 20_000]
                yield pa.record_batch([pa.array([w.decode("utf-8", "replace") for w, _ in part], pa.string()), pa.nulls(len(part), pa.int64()), pa.array([n for _, n in part], pa.int64())], names=["word", "gram", "n"])

        def flush_grams() -> Iterator[pa.RecordBatch]:
            keys, n = _merge(parts)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.record_batch([pa.nulls(len(part), pa.string()), pa.array(part, pa.int64()), pa.array(n[at : at + 50_000], pa.int64())], names=["word", "gram", "n"])

        for batch in batches:
            lists = [words_of(t) for t in batch.column("text").to_pylist()]
            for ws in lists:
                words.update(ws)
            words[b""] += len(lists)
            texts = [spelled(ws) for ws in lists]
            del lists
            for a, b in byte_chunks(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
                keys, n = np.unique(keys_of(texts[a:b], depth)[0], return_counts=True)
                parts.append((keys, n))
                held += len(keys)
                del keys, n
                if held > MERGE:
                    parts[:] = [_merge(parts)]
                    held = len(parts[0][0])
                    if held > MERGE:
                        yield from flush_grams()
                        held = 0
            if len(words) > 1_000_000:
                yield from flush_words()
        yield from flush_words()
        if parts:
            yield from flush_grams()

    return train.select(text_of().alias("text")).mapInArrow(run, _COUNTS)


def fit(grams: DataFrame, depth: int = DEPTH) -> SuffixTree:
    """The suffix tree of summed (gram, n) counts. Levels are rolled up and tested in Spark; only retained rows are
    collected (at most 1/share per depth)."""
    levels = {depth: grams.select(F.col("gram").alias("key"), "n")}
    for d in range(depth - 1, -1, -1):
        shorter = levels[d + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask(d + 1))).alias("key")).agg(F.sum("n").alias("n"))
        levels[d] = stored(shorter, f"level-{d}")
    total = int(levels[0].agg(F.sum("n")).first()[0] or 0)
    context = F.shiftright("key", 8)
    sums = {d: levels[d].groupBy(context.alias("context")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds")) for d in range(1, depth + 1)}
    root = {r["key"]: r["n"] for r in levels[0].collect()}  # at most 256 rows
    shares = np.array([(root.get(b, 0) + ROOT_PRIOR) / (total + 256 * ROOT_PRIOR) for b in range(256)])
    contexts: list = [None] * (depth + 1)
    entries: list = [None] * (depth + 1)
    contexts[0] = (np.zeros(1, np.int64), np.zeros(1))
    entries[0] = (np.arange(256), shares)
    needed = np.zeros(0, np.int64)
    least = max(2.0, ENTRY_SHARE * total)
    for d in range(depth, 0, -1):
        rows = levels[d].withColumn("context", context)
        whole = rows.join(sums[d].where(F.col("all") >= CONTEXT_SHARE * total), "context")
        if d > 1:
            up = levels[d - 1].select(F.col("key").alias("pkey"), F.col("n").alias("pn"))
            upall = sums[d - 1].select(F.col("context").alias("pcontext"), F.col("all").alias("pall"))
        else:
            up = levels[0].select(F.col("key").alias("pkey"), F.col("n").alias("pn"))
            upall = levels[0].agg(F.sum("n").alias("pall")).select(F.lit(0).cast("long").alias("pcontext"), "pall")
        low = mask(d - 1)
        parent = whole.withColumns({"pkey": F.col("key").bitwiseAND(F.lit(mask(d))), "pcontext": F.col("context").bitwiseAND(F.lit(low))})
        parent = parent.join(up, "pkey").join(upall, "pcontext")
        gain = F.col("n") * F.ln((F.col("n") / F.col("all")) / (F.col("pn") / F.col("pall")))
        tested = parent.groupBy("context").agg(
            F.max("all").alias("all"), F.max("kinds").alias("kinds"), F.sum(gain).alias("gain"),
            F.collect_list(F.when(F.col("n") >= least, F.struct("key", "n"))).alias("kept"),
        )
        passed = (F.col("gain") >= GAIN * F.col("kinds"))
        if len(needed):
            need = grams.sparkSession.createDataFrame(pa.table({"context": pa.array(needed)}))
            tested = tested.join(F.broadcast(need.withColumn("needed", F.lit(True))), "context", "left").where(passed | F.col("needed"))
        else:
            tested = tested.where(passed)
        table = tested.select("context", "all", "kinds", "kept").toArrow()
        order = np.argsort(table.column("context").to_numpy(), kind="stable")
        own = table.column("context").to_numpy()[order]
        all_, kinds = (table.column(c).to_numpy()[order].astype(float) for c in ("all", "kinds"))
        kept = table.column("kept").combine_chunks().take(pa.array(order)) if len(order) else None
        if kept is None:
            contexts[d], entries[d] = (np.zeros(0, np.int64), np.zeros(0)), (np.zeros(0, np.int64), np.zeros(0))
            needed = np.zeros(0, np.int64)
            continue
        sizes = np.diff(kept.offsets.to_numpy())
        flat = kept.flatten()
        keys, n = flat.field("key").to_numpy(), flat.field("n").to_numpy().astype(float)
        owner = np.repeat(np.arange(len(own)), sizes)
        share = n / (all_ + kinds)[owner]
        left = 1.0 - np.bincount(owner, share, len(own))
        sort = np.argsort(keys, kind="stable")
        contexts[d], entries[d] = (own, left), (keys[sort], share[sort])
        needed = np.unique(own & low) if d > 1 else needed
    return SuffixTree(contexts, entries)


def mixture(share: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """log10 probability of a token from its share of the training tokens and its spelling by the tree (log10)."""
    return np.log10((1 - TREE_WEIGHT) * share + TREE_WEIGHT * 10.0 ** np.maximum(tree, -250.0))


def scored(docs: DataFrame, folds: int = 5, out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == out).alias("held_out"), text_of().alias("text"))
    table = counts(rows.where(~F.col("held_out")))
    with batch_rows(docs.sparkSession, TEXTS):
        both = stored(table.groupBy("word", "gram").agg(F.sum("n").alias("n")), "lm-counts")
    words = both.where("word is not null").select("word", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = fit(both.where("gram is not null").select("gram", "n"))
    common = {r["word"].encode(): r["n"] for r in words.where(F.col("n") >= max(1.0, COMMON_SHARE * total)).collect()} if total else {}  # at most 1/COMMON_SHARE
    common.setdefault(END.encode(), 0)
    whole = total + 0.5 * (kinds + 1)
    place = {w: i for i, w in enumerate(common, 1)}  # 0 stands for every rare word
    times = np.array([0, *common.values()], float)
    known_base, shares = np.log10((times + 0.5) / whole), times / max(total, 1)
    end_known = int(common[END.encode()] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, row = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            lists = [words_of(t) for t in batch.column("text").to_pylist()]
            texts = [spelled(ws) for ws in lists]
            tokens = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
            known, base, score, rare = np.zeros(len(lists), np.int64), np.zeros(len(lists)), np.zeros(len(lists)), []
            sizes, spellings = [np.zeros(1, np.int64)], [np.zeros(0)]
            for a, b in byte_chunks(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
                flat = [w for ws in lists[a:b] for w in (*ws, b"")]
                first_token = np.concatenate([[0], np.cumsum(tokens[a:b])[:-1]])
                own = np.fromiter(map(place.get, flat, repeat(0)), np.int64, len(flat))
                keys, at = keys_of(texts[a:b])
                last = (keys & 255 == 32) | (keys & 255 == 10)  # a token ends in its space, the text in its newline
                spell = np.add.reduceat(tree.log10(keys), np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]))
                is_rare = own == 0
                mixed = np.where(is_rare, 0.0, mixture(shares[own], spell))
                known[a:b] = np.add.reduceat(~is_rare, first_token, dtype=np.int64)
                if not end_known:
                    known[a:b] -= 1
                base[a:b] = np.add.reduceat(np.where(is_rare, 0.0, known_base[own]), first_token)
                score[a:b] = np.add.reduceat(mixed, first_token)
                at_rare = np.flatnonzero(is_rare)
                sizes.append(np.diff(np.searchsorted(at_rare, np.append(first_token, len(flat)))))
                rare += [flat[i].decode("utf-8", "replace") for i in at_rare.tolist()]
                spellings.append(spell[at_rare])
            items = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(np.concatenate(spellings))], ["word", "tree"])
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), items)
            size = len(texts)
            yield pa.record_batch(
                [pa.array(np.arange(first + row, first + row + size), pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), rare],
                names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
            )
            row += size

    with batch_rows(docs.sparkSession, TEXTS):
        partial = stored(rows.mapInArrow(run, _PARTIAL), "lm-partial")
    rest = partial.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.tree").join(words, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    own = F.log10((c + 0.5) / F.lit(float(whole)))
    both_ways = F.log10(F.lit(1 - TREE_WEIGHT) * c / F.lit(float(max(total, 1))) + F.lit(TREE_WEIGHT) * F.pow(F.lit(10.0), F.greatest(F.col("tree"), F.lit(-250.0))))
    added = rest.groupBy("uid").agg(F.sum((c > 0).cast("long")).alias("k"), F.sum(own).alias("b"), F.sum(both_ways).alias("s"))
    return partial.drop("rare").join(added, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir):
    """op5: scores of all ``documents``."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
