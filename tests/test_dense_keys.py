"""Key checks by bitmaps: the plain way's answers, without moving unique keys."""

from __future__ import annotations

import glob
import json
import random
import tempfile
import time
import uuid

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import quality
from tests.conftest import EVENT_LOG_DIR, rows


def _shuffled(spark, run) -> int:
    """Shuffle bytes written by the jobs of ``run``, from the event log."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    deadline = time.time() + 30
    while True:
        jobs, stages, ended, written = set(), set(), set(), 0
        for f in glob.glob(f"{EVENT_LOG_DIR}/**/events_*", recursive=True) + glob.glob(f"{EVENT_LOG_DIR}/local-*"):
            with open(f) as log:
                for line in log:
                    try:
                        e = json.loads(line)
                    except json.JSONDecodeError:  # still being written
                        continue
                    if e["Event"] == "SparkListenerJobStart" and (e.get("Properties") or {}).get("spark.jobGroup.id") == group:
                        jobs.add(e["Job ID"])
                        stages.update(e["Stage IDs"])
                    elif e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages:
                        written += e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                    elif e["Event"] == "SparkListenerJobEnd":
                        ended.add(e["Job ID"])
        if (jobs and jobs <= ended) or time.time() > deadline:
            return written
        time.sleep(1)


@pytest.mark.parametrize("kind", ["int", "bigint", "smallint"])
def test_violations_are_the_same(spark, kind):
    r = random.Random(4)
    edge = [None, 0, 0, -1, 32_767, 32_767, -32_768] + ([2**63 - 1, 2**63 - 1, -(2**63), 32_768, 32_769, 32_769] if kind == "bigint" else [])
    fact = [*edge, None, *(r.randint(-300, 300) for _ in range(200)), *([7] * 50)]
    dim = [None, None, 0, 7, 7, -1, *range(-300, 0, 2), *range(1, 250)]
    f = spark.createDataFrame([(i, "x") for i in fact], "k bigint, other string").select(F.col("k").cast(kind), "other").repartition(5)
    d = spark.createDataFrame([(i,) for i in dim], "k bigint").select(F.col("k").cast(kind))
    key = lambda x: [repr(v) for v in x]
    for df in (f, d, f.limit(0), f.dropDuplicates(["k"])):
        assert sorted(map(key, quality.pk_violations(df, ["k"], dense_ids=True).collect())) == sorted(map(key, quality.pk_violations(df, ["k"]).collect()))
    for a, b in ((f, d), (d, f), (f, f), (f, d.limit(0)), (f.limit(0), d)):
        assert rows(quality.orphan_keys(a, "k", b, "k", dense_ids=True)) == rows(quality.orphan_keys(a, "k", b, "k"))


def test_other_keys_are_refused(spark):
    df = spark.createDataFrame([("a", 1.5)], "s string, d double")
    for column in ("s", "d"):
        with pytest.raises(ValueError, match="integer"):
            quality.pk_violations(df, [column], dense_ids=True)
    with pytest.raises(ValueError, match="integer"):
        quality.orphan_keys(spark.range(3), "id", df, "s", dense_ids=True)


def test_unique_keys_are_not_moved(spark):
    n = 400_000
    path = f"{tempfile.mkdtemp(prefix='ids-')}/ids"  # a plain range is known to be partitioned by id
    spark.range(0, n, 1, 4).write.parquet(path)
    ids = spark.read.parquet(path)
    plain = _shuffled(spark, lambda: quality.pk_violations(ids, ["id"]).collect())
    dense = _shuffled(spark, lambda: quality.pk_violations(ids, ["id"], dense_ids=True).collect())
    assert plain > 0 and dense < 0.1 * plain, (plain, dense)
    plain = _shuffled(spark, lambda: quality.orphan_keys(ids, "id", ids, "id").collect())
    dense = _shuffled(spark, lambda: quality.orphan_keys(ids, "id", ids, "id", dense_ids=True).collect())
    assert dense < 0.1 * plain, (plain, dense)
