"""The quality classifier: held-out accuracy, compiled scores against rules by hand, odd rows."""

import math
import zlib

import pytest

from storelytics.llm import queries
from storelytics.llm import rule_ensemble as ens
from storelytics.llm.common import cut, table

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.queries()["op7_quality_classifier"](spark, FOLDER).collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    marks = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out for i, r in got.items())
    right = sum(r.predicted == q for r, q in marks) / len(marks)
    good, bad = [r.score for r, q in marks if q], [r.score for r, q in marks if not q]
    ranked = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    print("held-out accuracy", right, "area", ranked, "good kept", sum(x >= 0.3 for x in good) / len(good), "bad caught", sum(x < 0.3 for x in bad) / len(bad))
    assert right > 0.95 and ranked > 0.95


def labelled(spark, docs, rows, labels):
    table = docs(*rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return table, marks


def test_compiled_score_is_the_sum_of_rules(spark, docs):
    rows = [(i, ("good words here and there " * (1 + i % 7)) if i % 3 else "### $$$ %%% 12 " * (1 + i % 5)) for i in range(200)]
    table, marks = labelled(spark, docs, rows, [(i, int(i % 3 > 0), 0) for i in range(200)])
    numbers = ens.cut(ens.with_statistics(table.select("doc_id", "text")))
    model = ens.learn(numbers, marks)
    assert model.rules
    for r in numbers.withColumn("score", model.score()).collect():
        s = r[ens.STATS]
        z = model.intercept + sum(w.weight for w in model.rules if all(low < s[i] <= high for i, low, high in w.ranges))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))
    kept = ens.keep_good(table, marks).collect()
    assert {r.doc_id for r in kept} == {i for i in range(200) if i % 3} and kept[0].asDict().keys() == set(table.columns)


def test_odd_rows_and_missing_labels(spark, docs):
    rows = [(1, None), (2, ""), (3, "  "), (None, "a b"), (4, "x" * 300_000), (5, "w " * 100_000), (5, "w " * 100_000)]
    table, marks = labelled(spark, docs, rows, [(1, 1, 0), (3, 1, 0), (4, None, 0), (None, 0, 0)])
    assert {round(r.score, 6) for r in ens.scored(table, marks).collect()} == {0.75}
    assert {r.score for r in ens.scored(table, marks.limit(0)).collect()} == {0.5}
    assert ens.scored(table.limit(0), marks).count() == 0


def test_statistics():
    assert ens.statistics(None) == ens.statistics(" \n") == [0.0] * len(ens.NAMES)
    s = dict(zip(ens.NAMES, ens.statistics("Ab 12 #x\nAb 12 #x\nb ü")))
    assert (s["words"], s["lines"], s["upper"], s["digits"], s["symbols"]) == (8, 3, 2 / 15, 4 / 15, 2 / 15)
    assert s["repeated_lines"] == pytest.approx(1 / 3) and s["bare_words"] == 0.5


def test_scores_do_not_turn_on_the_partitioning(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))

    def scores(of):
        return {r.doc_id: (r.score, r.predicted) for r in ens.scored(of, labels).collect()}

    one, other = scores(docs), scores(cut(docs.repartition(7)))
    assert {k: v[1] for k, v in one.items()} == {k: v[1] for k, v in other.items()}
    assert max(abs(one[k][0] - other[k][0]) for k in one) < 1e-9


def test_keeping_keeps_every_column(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    wide = cut(docs.selectExpr("*", "doc_id * 2 AS _row", "1 AS __row"))
    kept = ens.keep_good(wide, labels)
    assert kept.columns == wide.columns and 0 < kept.count() < wide.count()
    assert kept.filter("_row <> doc_id * 2").count() == 0
