"""Quality rules by distribution divergence, with DataFrame functions only: two scans for the references, one for the verdicts.

References are learned from the corpus, for each language of `lang`: the median share of each character class and the most
common words with their shares, counted in all its documents of `MIN_WORDS` words or more. A document's histograms of
character classes and of common words are compared with each reference by Jensen-Shannon distance (base 2, 0 to 1); the
nearest language counts, so a wrong or missing `lang` doesn't matter.
Either distance is held against a document on its own, where it is over what a text of that length scatters by
chance from a reference, and a margin. Guards: below `MIN_WORDS` words (classes) and `WORD_WORDS` (words) nothing is; nor are
classes of a document written mostly in another script than the references; and words are held against those references
only of whose common words a document has some, so not against one in an unknown language. Base rules on length and repeated windows come first.

Defined results: a null or empty text has no words and fails the base rules; a very long text is judged whole; repeated rows
are judged one by one, and equal distances alike; languages with fewer than `LEAST_DOCS` documents have no reference, and
without any reference the base rules alone decide; an empty table gives no rows; columns beside text are passed on, whatever
their names, by `kept` too, which drops rows and changes none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, ascii_words, let

WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30
#: Documents that the references of the query's SQL are counted in, at most about; `learned` counts in all.
FIT_DOCS = 5_000
#: The least documents of a language with a reference; the languages kept; common words of each.
LEAST_DOCS, MOST_LANGS, COMMON = 20, 20, 10
#: Parts of a share in which medians are found.
PARTS = 1_000
#: Most distance of a text of n words: the first number and the second over the root of n. The second is what sampling 7
#: classes of some 5 n characters, or 11 word counts of n words, gives by chance; the first is the margin.
CLASS_LIMIT, WORD_LIMIT = (0.14, 0.47), (0.20, 1.35)
#: Words from which the word distance counts; the share of characters beyond ASCII from which a text is in another script; the
#: share of a reference's common words, relative to the reference's own, below which a text is in no known language.
WORD_WORDS, SCRIPT, KNOWN = 50, 0.2, 0.25
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other", "high")
_SPACE, _SYMBOL = r"[\x20\x09-\x0D]+", "[#*$%&|<>]+"


@dataclass(frozen=True)
class References:
    """For each language the shares of the character classes, and (word, share) of its common words."""

    classes: dict[str, tuple[float, ...]]
    words: dict[str, tuple[tuple[str, float], ...]]


def with_classes(df: DataFrame, text: str) -> DataFrame:
    """df and, as columns, the characters of each class. Lower case goes first, so that all others are looked for in a quarter of a text."""
    rest = text
    for k, pattern in (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("space", _SPACE), ("symbol", _SYMBOL), ("other", r"[\x00-\x7F]+")):
        df = df.withColumn(f"{P}less_{k}", F.regexp_replace(rest, pattern, "")).withColumn(f"{P}c_{k}", F.char_length(rest) - F.char_length(f"{P}less_{k}"))
        rest = f"{P}less_{k}"
    return df.withColumn(f"{P}c_high", F.char_length(rest)).drop(*(f"{P}less_{k}" for k in CLASSES))


def learned(docs: DataFrame) -> References:
    """References of the documents' languages, from all documents; none where there is no column `lang`."""
    if "lang" not in docs.columns:
        return References({}, {})
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    # of a language at most classes x parts
    part = F.explode(F.when(F.col("words") >= MIN_WORDS, F.array(*(F.struct(F.lit(i).alias("i"), F.floor(PARTS * F.col(f"{P}c_{k}") / F.char_length("text")).alias("part")) for i, k in enumerate(CLASSES))))).alias("x")
    parts = with_classes(rows.withColumn("words", F.size(ascii_words(F.col("text")))), "text").select("lang", "words", part).groupBy("lang", "x.i", "x.part").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    # each document is counted once in the first class
    first = lambda c: F.sum(F.when(F.col("i") == 0, F.col(c)).otherwise(0)).alias(c)
    known = parts.groupBy("lang").agg(first("n"), first("words"), F.sort_array(F.collect_list(F.struct("i", "part", F.col("n").alias("docs")))).alias("parts")).filter(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not known:
        return References({}, {})
    total, classes = {r.lang: r.words for r in known}, {}
    for r in sorted(known, key=lambda r: r.lang):
        middle = [_median([(x.part, x.docs) for x in r.parts if x.i == i]) for i in range(len(CLASSES))]
        classes[r.lang] = tuple(m / sum(middle) for m in middle)
    long_enough = let(ascii_words(F.col("text")), lambda w: F.when(F.size(w) >= MIN_WORDS, w))
    counted = rows.filter(F.col("lang").isin(sorted(total))).select("lang", F.explode(long_enough).alias("word")).select("lang", F.lower("word").alias("word")).groupBy("lang", "word").count().filter(F.col("word").rlike(r"^\p{L}+$"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    words: dict[str, list] = {k: [] for k in sorted(total)}
    for r in counted.withColumn("place", place).filter(F.col("place") <= COMMON).orderBy("lang", "place").collect():
        words[r.lang].append((r.word, r["count"] / total[r.lang]))
    return References(classes, {k: tuple(v) for k, v in words.items()})


def _median(parts: list[tuple[int, int]]) -> int:
    half, so_far = sum(n for _, n in parts), 0
    for part, n in parts:
        so_far += n
        if 2 * so_far >= half:
            return part
    raise ValueError("no parts")


def repeated_words(words: Column, n: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more, the first included; window is a power of 2.

    Most texts have no such window, which a set of window hashes shows; only for the others are the hashes sorted. A
    window's hash is that of its halves' hashes.
    """
    def doubled(hashes: Column, width: int) -> Column:
        left = lambda h: F.greatest(F.size(h) - width, F.lit(0))
        return let(hashes, lambda h: F.zip_with(F.slice(h, 1, left(h)), F.slice(h, width + 1, left(h)), lambda a, b: F.xxhash64(a, b)))

    windows, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < window:
        windows, width = doubled(windows, width), 2 * width

    def covered(found: Column) -> Column:
        by_hash = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(by_hash, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(s, i + 1).h == x.h, F.lit(False))))
        at = F.sort_array(F.transform(again, lambda x: x.i))
        # a window adds the words that the one before didn't cover
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(window), i - a.last)).alias("n")), lambda a: a.n)

    counted = let(windows, lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(F.lit(0).cast("long")))
    return F.when(n > window, counted).otherwise(F.lit(0).cast("long"))


def _distance(counts: Column, total: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of counts / total from the shares."""
    def part(c: Column, q: Column) -> Column:
        p = c / total
        mid = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mid)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / mid)).otherwise(0.0)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(counts, F.lit(shares), part), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _over(distance: Column, n: Column, limit: tuple[float, float]) -> Column:
    return distance > limit[0] + limit[1] / F.sqrt(n.cast("double"))


def judged(docs: DataFrame, prefix: str = "", references: References | None = None) -> DataFrame:
    """The input's columns and, named with the prefix, the base measures, both distances (null without a reference to hold), base_failed and kept.
    Without references, those of the documents themselves are learned."""
    refs = learned(docs) if references is None else references
    t, words, n = F.col(f"{P}t"), F.col(f"{P}words"), F.col(f"{P}n")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = sorted({w for x in refs.words.values() for w, _ in x})
    # as they are found in texts, so that words needn't be lowered before they are looked up
    spelled = sorted({f for w in common for f in (w, w.capitalize(), w.upper()) if f.lower() == w})
    df = docs.select("*", F.coalesce(F.col("text"), F.lit("")).alias(f"{P}t"), ascii_words(F.col("text")).alias(f"{P}words"))
    met = F.transform(F.filter(words, lambda w: w.isin(spelled)), lambda w: F.lower(w)) if common else F.array().cast("array<string>")
    df = with_classes(df, f"{P}t")
    df = df.select("*", F.size(words).alias(f"{P}n"), F.char_length(t).alias(f"{P}chars"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias(f"{P}dup_lines"),
                   repeated_words(words, F.size(words)).alias(f"{P}repeat"), met.alias(f"{P}met"))
    col = lambda k: F.col(f"{P}{k}")
    hist = let(col("met"), lambda c: F.array(*(F.size(c) - F.size(F.array_remove(c, w)) for w in common))) if common else F.array().cast("array<int>")
    df = df.select("*", hist.alias(f"{P}hist"), F.array(*(col(f"c_{k}") for k in CLASSES)).alias(f"{P}classes"))
    by_class, by_word = [], []
    for lang in refs.classes:
        by_class.append(_distance(col("classes"), col("chars"), list(refs.classes[lang])))
        shares = [s for _, s in refs.words[lang]]
        own = F.transform(F.lit([common.index(w) for w, _ in refs.words[lang]]), lambda i: F.get(col("hist"), i)) if shares else F.array().cast("array<int>")
        mass = F.aggregate(own, F.lit(0), lambda a, x: a + x)
        by_word.append(F.struct(_distance(F.concat(own, F.array(n - mass)), n, [*shares, 1 - sum(shares)]).alias("distance"), (mass / n / max(sum(shares), 1e-9)).alias("known")))
    some = (n > 0) if by_class else F.lit(False)
    nearest = F.array_min(F.array(*by_class)) if by_class else F.lit(None).cast("double")
    nearest_word = F.array_min(F.transform(F.filter(F.array(*by_word), lambda x: x.known >= KNOWN), lambda x: x.distance)) if by_word else F.lit(None).cast("double")
    df = df.select("*", F.when(some, nearest).alias(f"{P}by_class"), F.when(some, nearest_word).alias(f"{P}by_word"), ((n < MIN_WORDS) | (100 * col("repeat") > MAX_REPEATED_PERCENT * n)).alias(f"{P}failed"))
    far = (col("c_high") <= SCRIPT * col("chars")) & _over(col("by_class"), n, CLASS_LIMIT) | (n >= WORD_WORDS) & _over(col("by_word"), n, WORD_LIMIT)
    named = {"n_words": n.cast("long"), "word_chars": (col("chars") - col("c_space")).cast("long"), "n_symbols": col("c_symbol").cast("long"), "n_dup_lines": col("dup_lines"), "n_repeat_words": col("repeat"),
             "class_distance": col("by_class"), "word_distance": col("by_word"), "base_failed": col("failed"), "kept": ~col("failed") & ~F.coalesce(far, F.lit(False))}
    # generated, not selected: a filter on one of these would be pushed below the measures, with all of them written out in it wherever they are used
    return df.select(*docs.columns, F.inline(F.array(F.struct(*(c.alias(prefix + k) for k, c in named.items())))))


def kept(docs: DataFrame, references: References | None = None) -> DataFrame:
    """The documents that pass."""
    return judged(docs, P, references).filter(f"{P}kept").select(*docs.columns)
