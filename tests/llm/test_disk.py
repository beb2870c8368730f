"""What the operators leave on disk: tables that no result reads go, and so do the shuffles behind written tables."""

import os
import random
import re
import time

from pyspark.sql import functions as F

import pytest

from tagwave.llm.common import passing, written
from tagwave.llm.jaccard_join import jaccard_components
from tagwave.llm.line_dedup import dedup_lines
from tagwave.session import ensure_checkpoint_dir


def folders(spark):
    return set(os.listdir(at)) if os.path.isdir(at := os.path.join(ensure_checkpoint_dir(spark).removeprefix("file://"), "tagwave")) else set()


def shuffles(spark):
    return {f for d, _, names in os.walk(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
                                         .localDirsString()[0]) for f in names if f.startswith("shuffle_")}


def corpus(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300)]
    texts = [[rng.choice(vocab) for _ in range(60)] for _ in range(30)]
    texts += [[*t[:-1], rng.choice(vocab)] for t in texts]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_tables_go_but_for_the_kept_ones(spark):
    before = folders(spark)
    with passing(spark) as keep:
        with passing(spark) as inner:
            written(spark.range(3), "gone")
            held = inner(written(spark.range(4), "held").where("id > 0").unionByName(written(spark.range(9, 11), "also")))
        assert {re.match("llm-([a-z]+)", f)[1] for f in folders(spark) - before} == {"held", "also"}
        out = keep(written(held, "out"))
    assert {re.match("llm-([a-z]+)", f)[1] for f in folders(spark) - before} == {"out"}
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 9, 10]


def test_shuffles_go_once_a_table_is_written(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(name, None)
    before = shuffles(spark)
    out = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 7 and spark.conf.get(name, None) == given


@pytest.mark.parametrize("step, kept", [(lambda d: jaccard_components(d, words=3, percent=80), {"sets", "of-set"}),
                                        (lambda d: dedup_lines(d), {"line-places", "first-lines"})])
def test_operators_leave_only_what_their_result_reads(spark, step, kept):
    """No lists of keys, marks, bands, pairs or labels stay, and the result can still be read, twice."""
    before = folders(spark)
    out = step(corpus(spark))
    assert {re.match("llm-(.*)-[0-9a-f]{12}", f)[1] for f in folders(spark) - before} == kept
    assert sorted(map(str, out.collect())) == sorted(map(str, out.collect())) and out.count() == 60
