"""Line dedup by winnowing: later copies of runs of lines go.

A run is ``run`` lines in a row, lines without a word left out of account. Of each run the line of least hash is its fingerprint (the
first of equals), so equal runs have equal fingerprints and a shared passage of that length always shares one. Fingerprints
of two or more places are joined; around each, the match is extended to the left and right over all runs it stands for,
compared by 128 bits of their text. A line goes if it lies in a run that occurred before: at a smaller doc_id, or earlier in the same text.
Blank lines between the lines of a deleted stretch go with it.

With ``long_words`` a run of fewer lines counts too if it holds that many words, so a long repeated passage goes however few lines it has;
such runs have fingerprints of their own width.

Counts and firsts are combined before each shuffle; the joins are between written tables, which adaptive execution may split
at a hot run. Only DataFrame and SQL functions are used.

Null texts stay null, empty and short texts as they are. Repeated rows are copies of each other; null ids come last. Rows are told
apart by place, so ``docs`` must be a table at rest. All columns are kept; ``n_lines`` and ``n_removed`` are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.llm.common import cut

RUN = 3
_WORD = r"[^\x20\x09-\x0D]"


def _of_width(width: int, words: int) -> str:
    """SQL over ``l``, ``h`` and ``n`` (a text's lines, their hashes and word counts): fingerprints of the runs of ``width`` lines.

    Runs of fewer than ``words`` words are NULL. The width is part of the fingerprint: runs of different widths never meet.
    """
    picks = f"""
        transform(sequence(0, size(h) - {width}), i ->
            array_min(transform(slice(h, i + 1, {width}), (x, j) -> named_struct('x', x, 'p', i + j))).p)"""
    long_enough = f"aggregate(slice(n, i + 1, {width}), 0, (a, x) -> a + x) >= {words}" if words else "true"
    return f"""
        if(size(h) < {width}, array(),
        transform(array({picks}), p -> transform(array(filter(sequence(0, size(p) - 1), i -> i = 0 OR p[i] <> p[greatest(i - 1, 0)])), b ->
            transform(b, (s, k) -> named_struct('fp', xxhash64(h[p[s]], {width}), 'first', s, 'width', {width}, 'runs',
                transform(sequence(s, if(k + 1 < size(b), b[least(k + 1, size(b) - 1)] - 1, size(p) - 1)),
                          i -> if({long_enough}, unhex(md5(cast(array_join(slice(l, i + 1, {width}), '\\n') AS binary))), NULL))))))[0][0])"""


def _fingerprints(docs: DataFrame, run: int, long_words: int | None) -> DataFrame:
    """(_row, place, fp, first, width, runs): each fingerprint with the hashes of the runs it stands for, from run ``first`` on."""
    widths = [_of_width(run, 0)] + [_of_width(w, long_words) for w in range(1, run) if long_words]
    counts = f"transform(l, x -> size(regexp_extract_all(x, R'{_WORD}+', 0)))" if long_words else "transform(l, x -> 0)"
    body = f"""
        transform(array(filter(split(text, '\\n'), x -> x RLIKE R'{_WORD}')), l ->
            transform(array(named_struct('h', transform(l, x -> xxhash64(x)), 'n', {counts})), g ->
                transform(array(g.h), h -> transform(array(g.n), n ->
                    filter(concat({", ".join(widths)}), f -> exists(f.runs, r -> r IS NOT NULL))))))[0][0][0][0]"""
    placed = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.expr(body).alias("found"))
    return placed.select(
        "_row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")).alias("place"),
        F.expr("inline(found)"),
    )


def repeated(docs: DataFrame, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """(_row, starts): places of the lines with a word that lie in a run that occurred before, for texts that have any."""
    every = cut(_fingerprints(docs, run, long_words))
    shared = cut(every.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"))
    matched = every.join(shared, "fp", "left_semi").select("_row", "place", "first", "width", F.posexplode("runs").alias("k", "run")).filter("run IS NOT NULL")
    at = cut(matched.select("_row", "run", "width", F.struct("place", (F.col("first") + F.col("k")).alias("line")).alias("at")))
    firsts = cut(at.groupBy("run").agg(F.min("at").alias("origin"), F.count("*").alias("n")).filter("n > 1").select("run", "origin"))
    later = at.join(firsts, "run").filter("at <> origin").select("_row", F.struct("at.line", "width").alias("found"))
    spans = F.expr("transform(found, f -> sequence(f.line, f.line + f.width - 1))")
    return later.groupBy("_row").agg(F.collect_list("found").alias("found")).select(
        "_row", F.array_sort(F.array_distinct(F.flatten(spans))).alias("starts")
    )


def dedup(docs: DataFrame, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """``docs`` without the lines of later repeated runs, ``n_lines`` (with a word) and ``n_removed`` of them added.

    With ``long_words`` a run of fewer lines counts as well if it holds that many words.
    """
    found = cut(repeated(docs, run, long_words))
    # Texts with something to delete grow with the corpus: the join is a shuffle at every size, not only at large ones.
    placed = docs.withColumn("_row", F.monotonically_increasing_id()).join(found.hint("merge"), "_row", "left")
    # Lines that go next to each other make one stretch; between the stretches lie the lines that stay.
    body = f"""
        transform(array(split(text, '\\n')), l -> transform(array(filter(sequence(0, size(l) - 1), i -> l[i] RLIKE R'{_WORD}')), b -> named_struct(
            'n_lines', cast(size(b) AS bigint),
            'cut', if(starts IS NULL, NULL, transform(array(named_struct(
                'from', filter(starts, (s, k) -> k = 0 OR s - starts[greatest(k - 1, 0)] > 1),
                'upto', transform(filter(starts, (s, k) -> k = size(starts) - 1 OR starts[least(k + 1, size(starts) - 1)] - s > 1), s -> s + 1))),
                c -> named_struct(
                    'n', aggregate(arrays_zip(c.from, c.upto), 0L, (a, z) -> a + z.upto - z.from),
                    'text', array_join(flatten(transform(sequence(0, size(c.from)), k -> slice(l,
                        if(k = 0, 1, b[c.upto[greatest(k - 1, 0)] - 1] + 2),
                        greatest(if(k = size(c.from), size(l), b[c.from[least(k, size(c.from) - 1)]])
                            - if(k = 0, 0, b[c.upto[greatest(k - 1, 0)] - 1] + 1), 0)))), '\\n')))[0]))))[0][0]"""
    done = placed.withColumn("_done", F.when(F.col("text").isNotNull(), F.expr(body)))
    return (
        done.withColumn("text", F.coalesce("_done.cut.text", "text"))
        .withColumn("n_lines", F.coalesce("_done.n_lines", F.lit(0).cast("long")))
        .withColumn("n_removed", F.coalesce("_done.cut.n", F.lit(0).cast("long")))
        .drop("_row", "starts", "_done")
    )
