import os
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pipelake.llm import common
from pipelake.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_keep_their_contract(spark):
    from tests.llm import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after and set(after) <= set(before)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "near-duplicates":
            groups = brute.near_components(before, 5, 80)
            assert set(after) == {i for i, c in groups.items() if i == c}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hits = brute.contaminated(before, items, 10)
            assert set(after) == {i for i, (_, n, _) in hits.items() if not n}
        if name == "personal data":
            assert set(after) == set(before) and all(brute.base_spans(t) == "" for t in after.values())
        if name == "sentencepiece":
            assert after == before
        before = after


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_take_odd_rows_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, hit string, ids string, base int, start int, _doc string, kept boolean"
    clean = "plain words of no harm that stand in a row and are read by all who come this way today and go on their way again tomorrow"
    rows = [(None, clean), (None, None), (1, None), (2, ""), (3, clean), (3, clean), (4, clean + " " + "x" * 3000), (5, "é " * 4000), (6, "  \t\n")]
    frame = spark.createDataFrame([(i, t, None, None, None, 7, "h", "i", 8, 9, "d", False) for i, t in rows], schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        found = written(stage(spark, frame, SF), "odd")
        assert stage(spark, frame.limit(0), SF).count() == 0
        kept[name] = sorted(str(r.doc_id) for r in found.collect())
        if name != "sentencepiece":
            assert found.columns == frame.columns
            assert all((r.node, r.hit, r.ids, r.base, r.start, r._doc, r.kept) == (7, "h", "i", 8, 9, "d", False) for r in found.collect())
    everything = sorted(str(i) for i, _ in rows)
    assert kept["quality rules"] == ["3", "3", "None"]
    assert kept["near-duplicates"] == [i for i in everything if i != "4"]
    assert kept["benchmark decontamination"] == kept["personal data"] == kept["sentencepiece"] == everything


def test_a_written_table_leaves_no_shuffle_behind(spark):
    """Stages of many rounds held the shuffle files of all of them, more than the disk has where there are many partitions."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    setting = spark.conf.get(common.SHUFFLES_GO, "false")
    for n in range(2, 6):
        grouped = spark.range(1000).groupBy((F.col("id") % n).alias("k")).count()
        before = {tracker.shuffleStatuses().size()}
        table = written(grouped, "grouped")
        until = time.time() + 3
        while tracker.shuffleStatuses().size() > max(before) and time.time() < until:
            time.sleep(0.1)
        assert tracker.shuffleStatuses().size() <= max(before)
        assert spark.conf.get(common.SHUFFLES_GO) == setting
        assert table.count() == n
