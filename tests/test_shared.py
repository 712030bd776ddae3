"""Stages follow the tables that they are made of."""

import os
import time

from waymark.sources import shared


def test_stages_follow_their_tables_and_are_released(spark, tmp_path):
    made = []

    @shared.staged
    def doubled(s, d):
        made.append(d)
        return s.read.parquet(f"{d}/t.parquet").selectExpr("2 * id as x")

    data = str(tmp_path / "data")
    get = lambda: sorted(r.x for r in doubled(spark, data).collect())
    spark.range(3).write.parquet(f"{data}/t.parquet")
    assert get() == get() == [0, 2, 4] and len(made) == 1
    time.sleep(0.02)
    spark.range(5).write.mode("overwrite").parquet(f"{data}/t.parquet")
    os.utime(f"{data}/t.parquet")
    assert get() == [0, 2, 4, 6, 8] and len(made) == 2
    kept = {k: v for k, v in shared._STAGES.items() if k[1] == data}
    assert len(kept) == 1 and os.path.isdir(next(iter(kept.values()))[1].removeprefix("file://"))
    others = {k: shared._STAGES.pop(k) for k in list(shared._STAGES) if k[1] != data}
    assert shared.release(spark) == 2 and not os.path.isdir(next(iter(kept.values()))[1].removeprefix("file://"))
    shared._STAGES.update(others)
    assert get() == [0, 2, 4, 6, 8] and len(made) == 3
