"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Tokens are runs of letters and digits, lower case. A mask of fixed length keeps some token positions and
ignores the others, so a window still has its hash when words at ignored positions were substituted. The
hashes of all windows of documents meet those of the benchmark's; around each hit the whole item is laid over
the document at that place and words are compared position by position; an overlap counts from `OVERLAP` on.
`clean` also counts shorter passages, which the rows of `overlaps` leave out unless `run` is given.

The benchmark is broadcast in blocks of items, hashes and words, of `BLOCK_BYTES` (or one item, if that is
larger); a larger benchmark takes a pass over the documents for each block. A place in a document that several seeds hit is
verified once: hits are put together before they leave the scan, and only documents with hits are shuffled. Items below
`SHORT` words have masks of their own, which find every overlap; no other item is probed with these.

Defined results: null or empty texts on either side have no overlap; items with equal texts are each
reported, texts with equal item_ids as one item, with the best place; repeated documents rows give one row for each doc_id
and item, with the best place; ties go to the first place; very long texts are compared whole; `clean` leaves items below
`LEAST_ITEM` words out, as a word or phrase would take every text that has it; an empty table on either side gives no rows;
other columns are not read, and `clean` passes them on, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, checked, written

#: 1: the position counts, 0: it is ignored.
MASKS = ("11101011", "1101100111", "1011010101")
OVERLAP = 0.8
#: Words of an item from which the masks above serve it.
SHORT = 15
#: Score of a passage of an item, its equal words less four times the others, from which `clean` drops a document.
RUN = 13
#: Words of the shortest item for which `clean` drops a document.
LEAST_ITEM = 8
#: Bytes of the benchmark that are broadcast together: about 40 for each hash, and 8 for each word.
BLOCK_BYTES = 24 << 20


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed_tokens(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(hashes: Column, mask: str) -> Column:
    """Of each window of the mask's length, the hash of the positions that count."""
    at = [k for k, c in enumerate(mask) if c == "1"]
    found = F.transform(F.sequence(F.lit(0), F.size(hashes) - len(mask)), lambda i: F.xxhash64(F.lit(mask), *(F.get(hashes, i + k) for k in at)))
    return F.when(F.size(hashes) >= len(mask), found).otherwise(F.array().cast("array<bigint>"))


def short_masks(n: int, least: float) -> list[str]:
    """Masks, one of which finds n words with as many substitutions as least allows, also where the document ends within the item.

    Of two groups of positions more than there can be substitutions, two are whole; a mask keeps two groups."""
    gone = n - max(1, ceil(least * n - 1e-9))
    kept = 2 if 0 < gone <= n - 2 else 1
    groups = gone + kept
    edges = [n * k // groups for k in range(groups + 1)]
    found = {}
    for chosen in combinations(range(groups), kept):
        at = [k for g in chosen for k in range(edges[g], edges[g + 1])]
        found["".join("01"[k in at] for k in range(at[0], at[-1] + 1))] = None
    return list(found)


def _items(benchmark: DataFrame, masks: tuple[str, ...], least: float, shortest: int) -> tuple[DataFrame, dict[str, Column]]:
    """Items (key, item_id, hashed tokens), and masks with the condition on items that they serve."""
    rows = benchmark.select("item_id", hashed_tokens(F.col("text")).alias(f"{P}item")).filter(F.size(f"{P}item") >= max(1, shortest))
    items = written(rows.select(F.xxhash64("item_id", f"{P}item").alias(f"{P}key"), "*"), "items")
    size = F.size(f"{P}item")
    serves = {m: size >= SHORT for m in masks}
    for n in sorted(r[0] for r in items.select(size).filter(size < SHORT).distinct().collect()):
        for m in short_masks(n, least):
            serves[m] = serves[m] | (size == n) if m in serves else size == n
    return items, serves


def blocks_of(items: DataFrame, serves: dict[str, Column]) -> list[tuple[DataFrame, DataFrame]]:
    """Items and their seeds (hash, key, place), in blocks: each block's seeds are those of its own items."""
    none = F.array().cast("array<bigint>")
    both = F.flatten(F.array(*(F.transform(seeds(F.when(c, F.col(f"{P}item")).otherwise(none), m), lambda h, i: F.struct(h.alias("h"), i.alias("i"))) for m, c in serves.items())))
    seeded = written(items.select(f"{P}key", both.alias(f"{P}seeds"), "item_id", f"{P}item"), "seeds")
    total = seeded.agg(F.sum(40 * F.size(f"{P}seeds").cast("long") + 8 * F.size(f"{P}item"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    out = []
    for b in range(n):
        own = seeded.filter(F.pmod(f"{P}key", F.lit(n)) == b) if n > 1 else seeded
        out.append((own.select(f"{P}key", "item_id", f"{P}item").distinct(), own.select(f"{P}key", F.explode(f"{P}seeds").alias("x")).select(F.col("x.h").alias(f"{P}h"), f"{P}key", F.col("x.i").alias(f"{P}at"))))
    return out


def places(docs: DataFrame, seeded: DataFrame, masks: list[str]) -> DataFrame:
    """Places to verify, each once: doc_id, the document's hashed tokens, the key of an item and where its first word would lie."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", F.xxhash64(text).alias(f"{P}text"), hashed_tokens(F.col("text")).alias(f"{P}doc"))
    doc, at = F.col(f"{P}doc"), F.col(f"{P}i")
    # a row for each token, then its windows' hashes outside of any lambda, where they are compiled
    rows = words.select("doc_id", f"{P}text", f"{P}doc", F.explode(F.when(F.size(doc) > 0, F.sequence(F.lit(0), F.size(doc) - 1))).alias(f"{P}i"))
    windows = F.array(*(F.when(at + len(m) <= F.size(doc), F.xxhash64(F.lit(m), *(F.get(doc, at + k) for k, c in enumerate(m) if c == "1"))) for m in masks))
    rows = rows.select("doc_id", f"{P}text", f"{P}doc", f"{P}i", F.explode(windows).alias(f"{P}h"))
    met = rows.join(F.broadcast(seeded), f"{P}h").select("doc_id", f"{P}text", f"{P}key", (F.col(f"{P}i") - F.col(f"{P}at")).alias(f"{P}start"), f"{P}doc")
    # a document's hits are in one task, so this puts them together before the shuffle
    return met.groupBy("doc_id", f"{P}text", f"{P}key", f"{P}start").agg(F.first(f"{P}doc").alias(f"{P}doc"))


def _hits(found: DataFrame, items: DataFrame, least: float, run: int | None) -> DataFrame:
    met = found.join(F.broadcast(items), f"{P}key")
    start = F.col(f"{P}start")
    same = F.transform(F.col(f"{P}item"), lambda w, k: F.coalesce(F.when(start + k >= 0, F.get(f"{P}doc", start + k)) == w, F.lit(False)))
    laid = met.select("doc_id", "item_id", f"{P}start", same.alias(f"{P}same"), F.size(f"{P}item").alias(f"{P}words"))
    enough = F.col(f"{P}matched") >= F.col(f"{P}words") * least
    if run is not None:
        # the best sum over a stretch, in one pass
        zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

        def add(x, equal):
            now = F.greatest(F.lit(0), x["now"] + F.when(equal, 1).otherwise(-4))
            return F.struct(now.alias("now"), F.greatest(x["best"], now).alias("best"))

        enough = enough | (F.aggregate(f"{P}same", zero, add)["best"] >= run)
    return laid.withColumn(f"{P}matched", F.size(F.filter(f"{P}same", lambda x: x))).filter(enough).drop(f"{P}same")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: float = OVERLAP, run: int | None = None, shortest: int = 1) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, start (token of the document), matched, item_words, overlap.
    With run, also for those that have a passage of that score in common, at one offset: parts of an item, and both sides of a word put in or left out."""
    items, serves = _items(benchmark, masks, least, shortest)
    hits = None
    for own, seeded in blocks_of(items, serves):
        found = _hits(places(docs, seeded, list(serves)), own, least, run)
        hits = found if hits is None else hits.unionByName(found)
    best = F.max(F.struct(F.col(f"{P}matched").alias("matched"), (-F.col(f"{P}start")).alias("back"), F.col(f"{P}words").alias("words"))).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.matched").cast("long").alias("matched"), F.col("best.words").cast("long").alias("item_words"),
        (F.col("best.matched") / F.col("best.words")).alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, of whole items or of a passage of score `RUN`; rows with one doc_id, or none, are told apart by their texts."""
    row = F.struct("doc_id", F.xxhash64("text").alias("text"))
    found = overlaps(docs.select(row.alias("doc_id"), "text"), benchmark, run=RUN, shortest=LEAST_ITEM)
    gone = checked(written(found.select(F.col("doc_id.doc_id").alias(f"{P}id"), F.col("doc_id.text").alias(f"{P}text")).distinct(), "contaminated"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(f"{P}id")) & (F.xxhash64("text") == F.col(f"{P}text")), "left_anti")
