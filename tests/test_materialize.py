from __future__ import annotations

import os

from cohortlens.plans.materialize import materialize, release


def test_materialize_then_release(spark):
    own = spark.newSession()  # its own registry of written tables
    m = materialize(own.range(10).withColumnRenamed("id", "x"), "unit")
    assert sorted(r.x for r in m.collect()) == list(range(10))
    path = m.inputFiles()[0].split("/part-")[0].replace("file:", "")
    assert os.path.isdir(path)
    assert release(own) == 1
    assert not os.path.exists(path)
    assert release(own) == 0
