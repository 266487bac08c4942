"""Spelling variants: words one letter apart, by PartEnum signatures over their letters.

A word's letters with repeats are a binary vector: one place for each letter and how often it has come so far. Two words that differ by
one inserted, deleted or replaced letter have vectors at most two apart. The places are dealt by letter into ``CLASSES`` classes;
at most two classes hold a difference, so the words agree in all the others. A signature is a word's letters in the
classes that are left when two are taken away, and every choice of two is a signature: near words share one at least.

Signatures are equi-joined. The join key also holds the part of the word that an edit leaves as it is, its first half or its second,
so a bucket holds words that agree in half their text and in the letters of half the classes; nothing else is paired. Every
pair from the join is then verified by its edit distance. Pairs of near words are few and are made distinct by an aggregate.

A word's form is its commonest near word if that is at least twice as common. Forms at least double the count with every step, so a
chain is no longer than the logarithm of the highest count, and its end is found by doubling pointers that many times over.

Null texts have no words, nor have empty ones. A word may be of any length and a text hold any number of words. Repeated
rows count again; rows of a null doc_id are treated like those of an empty one. An empty table gives no words. Of the input only
``doc_id`` and ``text`` are read, so other columns may be called anything. Counts are combined before they are shuffled.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.llm.common import ascii_lower, cut

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LETTERS, COUNT, DISTANCE, CLASSES, DROPPED = 5, 3, 1, 4, 97


def counted(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, dropped: int = DROPPED) -> DataFrame:
    """(word, n): words of ``letters`` letters that occur ``count`` times or more.

    One occurrence in ``dropped``, known by a checksum of document and run, loses a letter, as the words of a noisy scan do.
    """
    run, hashed, length = F.col("run"), F.col("h"), F.char_length("run")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(length >= letters)
    checked = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), run).cast("binary")).alias("h"))
    at = F.pmod(hashed, length).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, length))
    word = F.when(hashed % dropped == 0, short).otherwise(run).alias("word")
    words = checked.select(word).filter(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def _signatures(classes: int) -> Column:
    """Number and letters of each choice of classes: the letters of all classes but two."""
    kept = list(combinations(range(classes), classes - 2))
    return F.array(*[
        F.struct(F.lit(i).alias("choice"), F.concat_ws("\x01", *[F.col("letters")[c] for c in choice]).alias("kept"))
        for i, choice in enumerate(kept)
    ])


def _keyed(words: DataFrame, shorter: int, classes: int) -> DataFrame:
    """(key, word, n): a row per signature and half. ``shorter`` is by how much the shorter word of a pair may be shorter than this one."""
    sorted_letters = F.array_sort(F.split("word", ""))

    def of_class(number: int) -> Column:
        return F.array_join(F.filter(sorted_letters, lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(classes)) == number), "")

    dealt = F.array(*[of_class(c) for c in range(classes)])
    least = F.char_length("word") - shorter
    half = F.floor(least / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), half).alias("same")),
        F.struct(F.lit(1).alias("side"), F.substring(F.col("word"), F.char_length("word") - (least - half) + 1, F.char_length("word")).alias("same")),
    )
    chosen = words.select("word", "n", least.alias("least"), sides.alias("sides"), dealt.alias("letters")).select(
        "word", "n", "least", "sides", F.explode(_signatures(classes)).alias("sig")
    )
    halves = chosen.select("word", "n", "least", "sig", F.explode("sides").alias("half"))
    return halves.select(F.xxhash64("least", "sig.choice", "sig.kept", "half.side", "half.same").alias("key"), "word", "n")


def near_pairs(words: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(a, n_a, b, n_b): every two of ``words`` (word, n) that are one edit apart, once, the shorter or lesser word as ``a``."""
    short = _keyed(words, 0, classes).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = short.select("key", F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    longer = _keyed(words, 1, classes).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    either = other.unionByName(longer)
    size = F.char_length("b") - F.char_length("a")
    # All joins here are of tables that grow with the corpus. Planned by size, a written table is taken for its compressed bytes, and
    # exploded ones for those of the words, a twelfth of their rows: the driver would gather them for a broadcast.
    paired = short.join(either.hint("merge"), "key").filter((size == 1) | ((size == 0) & (F.col("a") < F.col("b"))))
    near = paired.filter(F.levenshtein("a", "b", DISTANCE) == DISTANCE)
    return near.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def _roots(forms: DataFrame, highest: int) -> DataFrame:
    """(word, root): the end of each word's chain of forms; after k rounds a pointer has gone 2^k steps."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, ceil(log2(max(1, log2(max(2, highest))))))):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return at


def variants(words: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n), a table at rest of distinct words."""
    pairs = cut(near_pairs(words, classes))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    # Least of (-count, word): the commonest, and of equals the first.
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= 2 * F.col("n")
    joined = words.join(found.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    judged = cut(joined)
    highest = judged.agg(F.max("n")).first()[0] or 1
    roots = _roots(judged.filter("form IS NOT NULL"), highest)
    return judged.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def grouped(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, dropped: int = DROPPED) -> DataFrame:
    """The variants among the words of ``docs``."""
    return variants(cut(counted(docs, letters, count, dropped)))
