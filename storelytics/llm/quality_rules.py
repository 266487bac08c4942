"""Quality rules whose cutoffs keep false rejections under a stated risk.

Each rule rejects texts whose metric lies beyond a cutoff. The cutoff is chosen per stratum from a fixed ladder, permissive
to strict, on labelled good documents: a step holds if the exact binomial probability of seeing as few rejections as were
seen, were the true false-rejection rate ``risk / number of rules``, is at most ``error / (rules x strata)``. Steps are tested in
order up to the first that fails, which costs no further correction; the division by rules and strata is Bonferroni's. So with
probability 1 - ``error``, the rules together reject at most a share ``risk`` of good documents in every stratum. A stratum with
too few labels gets no cutoff, and no document of it is rejected by these rules.

Everything is one scan of the texts, written out as numbers, then aggregates of numbers. A null text has no words; metrics
without a denominator are null and break no rule. A null stratum is a stratum. Labels that are null, or of absent
documents, count for nothing; repeated label rows of a document count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from storelytics.llm.common import cut

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
RISK, ERROR = 0.02, 0.05

# Rule: metric, then the ladder of cutoffs from permissive to strict. Negative metrics turn a lower limit into an upper one.
LADDERS = {
    "symbol_share": [round(1.0 - 0.02 * i, 2) for i in range(50)],
    "dup_line_share": [round(0.96 - 0.04 * i, 2) for i in range(24)],
    "repeat_share": [round(0.98 - 0.02 * i, 2) for i in range(48)],
    "word_length": [round(20 - 0.5 * i, 1) for i in range(32)],
    "short_words": [round(-1 - 0.25 * i, 2) for i in range(16)],
}
METRICS = {
    "symbol_share": "n_symbols / nullif(n_words, 0)",
    "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
    "repeat_share": "n_repeat_words / nullif(n_words, 0)",
    "word_length": "word_chars / nullif(n_words, 0)",
    "short_words": "-(word_chars / nullif(n_words, 0))",
}

# Words in 3-word windows found twice or more: window hashes sorted with their places, equal neighbours kept, covered words counted.
_REPEATS = """
    transform(array(if(size(w) >= 3, transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])),
                       cast(array() AS array<bigint>))), h ->
        if(size(array_distinct(h)) = size(h), 0L,
           transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
               aggregate(
                   sort_array(filter(transform(s, (e, j) ->
                       if((j > 0 AND s[greatest(j - 1, 0)].x = e.x) OR (j + 1 < size(s) AND s[least(j + 1, size(s) - 1)].x = e.x), e.i, -1)),
                       i -> i >= 0)),
                   named_struct('upto', 0, 'n', 0L),
                   (a, i) -> named_struct('upto', i + 3, 'n', a.n + 3 - greatest(a.upto - i, 0)),
                   a -> a.n))[0]))[0]"""
_BODY = f"""
    transform(array(coalesce(text, '')), t -> transform(array(array_remove(split(t, R'{GAP}'), '')), w ->
        transform(array(filter(split(t, '\\n'), l -> l RLIKE R'[^\\x20\\x09-\\x0D]')), l -> named_struct(
            'n_words', cast(size(w) AS bigint),
            'word_chars', cast(length(array_join(w, '')) AS bigint),
            'n_symbols', cast(regexp_count(t, R'{SYMBOLS}') AS bigint),
            'n_lines', cast(size(l) AS bigint),
            'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint),
            'n_repeat_words', {_REPEATS}))[0])[0])[0]"""


def counts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    return docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.expr(_BODY).alias("c")).select(
        "doc_id", "stratum", "c.*"
    )


def cutoffs(numbers: DataFrame, good: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum: the strictest cutoff of each rule that its labelled good documents allow, or null.

    ``numbers`` are ``counts``; ``good`` has the doc_id of every document labelled good.
    """
    rates = numbers.join(good.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "stratum", *[F.expr(m).cast("double").alias(r) for r, m in METRICS.items()]
    )
    steps = [(r, i, c) for r, ladder in LADDERS.items() for i, c in enumerate(ladder)]
    sums = rates.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.sum(F.when(F.col(r) > F.lit(float(c)), 1).otherwise(0)).alias(f"{r}_{i}") for r, i, c in steps],
    )
    listed = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{i}").alias("k"))
        for r, i, c in steps
    ])
    sums = cut(sums.select("stratum", "n", F.explode(listed).alias("s")).select("stratum", "n", "s.*"))
    rate = risk / len(LADDERS)
    strata = sums.select(F.count_distinct("stratum").alias("m")).scalar()
    tail = f"""
        if(k >= n * {rate}D, 1D, aggregate(
            slice(sequence(0L, k), 2, cast(k AS int)),
            named_struct('t', n * ln(1 - {rate}D), 's', exp(n * ln(1 - {rate}D))),
            (a, i) -> named_struct(
                't', a.t + ln((n - i + 1) / i) + ln({rate}D / (1 - {rate}D)),
                's', a.s + exp(a.t + ln((n - i + 1) / i) + ln({rate}D / (1 - {rate}D)))),
            a -> a.s))"""
    holds = F.expr(tail) <= F.lit(error) / (len(LADDERS) * strata)
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    passed = sums.withColumn("holds", F.min(holds).over(order)).filter("holds")
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in LADDERS])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """All counts, ``base_failed`` (under 50 words, or over half of them in repeated windows), the rules broken, and ``kept``."""
    numbers = cut(counts(docs, stratum))
    limits = cut(cutoffs(numbers, labels.filter("quality = 1"), risk, error))
    broken = F.filter(
        F.array(*[F.when(F.expr(m).cast("double") > F.col(f"cut_{r}"), F.lit(r)) for r, m in METRICS.items()]), lambda x: x.isNotNull()
    )
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return numbers.join(limits, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (F.size(broken) == 0)).alias("kept"), F.array_join(broken, ",").alias("broken_rules"),
    )
