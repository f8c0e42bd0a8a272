"""Scratch tables: gone after their scope, and verdicts that travel to the dishes."""

import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from larder.functions import dish_role as R
from larder.operators import menus as O
from larder.plans.fixtures import load
from larder.sources.scratch import scoped, stored, stored_alone


def folders(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_a_scope_leaves_nothing(spark, sf_dir, tmp_path):
    kept = stored(spark.range(3), "kept")
    before = folders(spark)
    with scoped(spark):
        with scoped(spark):
            stored(spark.range(5), "inner")
        guide = O.public_guide(*(load(spark, sf_dir, n) for n in ("restaurants", "featured", "dishes", "menu_sections")))
        assert len(folders(spark) - before) > 1
        guide.write.parquet(str(tmp_path / "guide"))
    assert folders(spark) == before and kept.count() == 3
    assert spark.read.parquet(str(tmp_path / "guide")).count() > 0


def test_verdicts_by_both_ways(spark, sf_dir, monkeypatch):
    """Sent to every task, or met in a join: the same roles; only the second moves the dishes by name."""
    rows = O.menu_dishes(load(spark, sf_dir, "dishes"), load(spark, sf_dir, "menu_sections")).unionByName(
        O.menu_dishes(load(spark, sf_dir, "dishes"), load(spark, sf_dir, "menu_sections")).limit(1).withColumns({"name": F.lit(None).cast("string"), "section": F.lit(None).cast("string")})
    )
    roles = lambda: sorted((r.id, r.role) for r in R.with_dish_role(rows, "section", "name").select("id", "verdict.role").collect())
    sent = roles()
    monkeypatch.setattr(R, "SENT", 0)
    assert roles() == sent and len(sent) == rows.count()


def test_shuffles_go_with_their_write(spark):
    """stored_alone leaves the table, the session as it was, and none of the files that its job shuffled; stored keeps those."""
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {str(f) for d in folders for f in Path(d).rglob("shuffle_*.data")}
    df, key = spark.range(1_000).repartition(3, "id"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, begun = spark.conf.get(key, None), files()
    alone = stored_alone(df, "alone")
    until = time.time() + 20
    while files() - begun and time.time() < until:  # executors are told without waiting for them
        time.sleep(0.1)
    assert not files() - begun and spark.conf.get(key, None) == was
    plain = stored(df, "plain")
    assert files() - begun
    assert alone.count() == plain.count() == 1_000
