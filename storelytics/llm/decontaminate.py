"""Benchmark decontamination: test n-grams as a broadcast hash set, token windows of the documents scanned against it.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A window is ``n`` words in a row
of a benchmark item; an item of fewer words is one window as a whole. A scan hashes every word once and combines
the hashes of the first few words at each position (``LEAD``, or fewer for shorter windows). Positions whose lead is
in the set of window leads are candidates; a join with the windows themselves then compares all words, so a hash
collision costs a comparison and never a result.

The set travels inside the scan up to ``SET_LEADS`` leads, counted beforehand. A larger benchmark goes through a join
of (lead, position) rows instead, whose side Spark broadcasts or shuffles by its size; the rows found are the same.

Null and empty texts have no words and no hits. Null or empty items have no windows. Repeated items of one id count once; a
null item id is left out of the items but its windows still hit. Rows are told apart by position, so repeated or null
document ids are no matter. Other columns of ``docs`` are ignored by ``hits`` and kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.llm.common import LOWER, UPPER, cut

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAD = 4
SET_LEADS = 50_000


def _words(column: str) -> str:
    return f"array_remove(split(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), R'{GAPS}'), '')"


def _lead(hashes: str, at: str, words: int) -> str:
    """Hash of the first words at a position: their hashes, shifted by place and combined."""
    return " ^ ".join(f"shiftleft({hashes}[{at} + {k}], {7 * k})" for k in range(words))


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(item_id, lead_words, lead, words): the distinct windows of the benchmark."""
    split = benchmark.select("item_id", F.expr(_words("text")).alias("w")).filter("size(w) > 0")
    slices = split.select(
        "item_id", F.expr(f"explode(transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n})))").alias("words")
    )
    leads = "CASE " + " ".join(
        f"WHEN size(h) {'>=' if k == LEAD else '='} {k} THEN {_lead('h', '0', k)}" for k in range(1, LEAD + 1)
    ) + " END"
    hashed = f"transform(array(transform(words, x -> xxhash64(x))), h -> {leads})[0]"
    return slices.distinct().select(
        "item_id", F.expr(f"least(size(words), {LEAD})").alias("lead_words"), F.expr(hashed).alias("lead"), "words"
    )


def _scanned(docs: DataFrame, test: str, n: int) -> DataFrame:
    """(_row, doc_id, n_words, found): candidate positions of each document, with the words that follow."""
    body = f"""
        transform(array({_words("text")}), w -> transform(array(transform(w, x -> xxhash64(x))), h ->
            named_struct('n_words', cast(size(w) AS bigint), 'found', {test})))[0][0]"""
    return docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.expr(body).alias("s")
    ).select("_row", "doc_id", "s.n_words", "s.found")


def _positions(k: int) -> str:
    return f"if(size(h) >= {k}, sequence(0, size(h) - {k}), cast(array() AS array<int>))"


def _candidates(docs: DataFrame, tests: DataFrame, n: int, set_leads: int) -> DataFrame:
    """(_row, doc_id, n_words, lead_words, lead, pos, words); documents without a candidate have one row of nulls."""
    sizes = {r[0]: r[1] for r in tests.groupBy("lead_words").agg(F.count_distinct("lead")).collect()}
    entry = f"named_struct('lead_words', {{k}}, 'lead', {{lead}}, 'pos', i, 'words', slice(w, i + 1, {n}))"
    fields = ["_row", "doc_id", "n_words", "c.*"]
    if sum(sizes.values()) <= set_leads:
        found = []
        for k in sorted(sizes):
            leads = [r[0] for r in tests.filter(F.col("lead_words") == k).select("lead").distinct().collect()]
            test = f"({_lead('h', 'i', k)}) IN ({', '.join(map(str, sorted(leads)))})"
            found.append(f"transform(filter({_positions(k)}, i -> {test}), i -> {entry.format(k=k, lead=_lead('h', 'i', k))})")
        none = f"slice(transform(array(0), i -> {entry.format(k=0, lead='0L')}), 1, 0)"
        scan = _scanned(docs, f"concat({', '.join([*found, none])})", n)
        return scan.select("_row", "doc_id", "n_words", F.explode_outer("found").alias("c")).select(*fields)
    every = ", ".join(f"transform({_positions(k)}, i -> {entry.format(k=k, lead=_lead('h', 'i', k))})" for k in sorted(sizes))
    scan = cut(_scanned(docs, f"concat({every})", n))
    rows = scan.select("_row", F.explode("found").alias("c")).select("_row", "c.*")
    kept = rows.join(tests.select("lead_words", "lead").distinct(), ["lead_words", "lead"], "left_semi")
    return scan.select("_row", "doc_id", "n_words").join(kept, "_row", "left").select(
        "_row", "doc_id", "n_words", "lead_words", "lead", "pos", "words"
    )


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, set_leads: int = SET_LEADS) -> DataFrame:
    """(_row, doc_id, n_words, spans, items) per document: where windows occur, merged, and the items they are from.

    ``spans`` is an array of (start, end) word offsets in order, end exclusive; ``items`` an array of item ids.
    """
    tests = cut(windows(benchmark, n))
    found = _candidates(docs, tests, n, set_leads)
    small = tests.count() <= set_leads
    whole = tests.select("item_id", "lead_words", "lead", F.col("words").alias("window"))
    same = [found[c] == whole[c] for c in ("lead_words", "lead")]
    verified = found.join(
        F.broadcast(whole) if small else whole,
        [*same, F.expr("slice(words, 1, size(window)) = window")],
        "left",
    ).select("_row", "doc_id", "n_words", "item_id", "pos", F.expr("pos + size(window)").alias("until"))
    per = verified.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("until").isNotNull(), F.struct(F.col("pos").alias("start"), F.col("until").alias("end"))))).alias("s"),
        F.collect_set("item_id").alias("items"),
    )
    merged = """
        aggregate(s, cast(array() AS array<struct<start:int,end:int>>), (a, o) ->
            if(size(a) > 0 AND a[size(a) - 1].end >= o.start,
               concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, o.end)))),
               concat(a, array(o))))"""
    return per.select("_row", "doc_id", "n_words", F.expr(merged).alias("spans"), "items")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, n)
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Documents that hold no window, all columns kept. ``docs`` must be a table at rest: its rows are told apart by place."""
    bad = hits(docs, benchmark, n).filter("size(spans) > 0").select("_row")
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(bad.hint("merge"), "_row", "left_anti").drop("_row")


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All documents with the words of the spans cut out of ``text``, together with what parts them from the next word."""
    found = hits(docs, benchmark, n).filter("size(spans) > 0").select("_row", "spans")
    gap = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # of texts not yet lower-cased
    word = f"[^{gap}]+[{gap}]*"
    pieces = f"regexp_extract_all(text, R'({word})', 1)"
    left = f"""
        concat(regexp_extract(text, R'^([{gap}]+)', 1), array_join(transform(array({pieces}), p ->
            filter(p, (x, i) -> NOT exists(spans, s -> i >= s.start AND i < s.end)))[0], ''))"""
    joined = docs.withColumn("_row", F.monotonically_increasing_id()).join(found.hint("merge"), "_row", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(left))
    return joined.withColumn("text", text).drop("_row", "spans")
