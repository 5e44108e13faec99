"""Scratch tables: one folder for what a step writes on its way, deleted with it."""

import os

import pytest
from pyspark.sql import functions as F

from sqlscore.session import checkpoint_root, drop_scratch, scratch_folder, scratch_path, stash


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_folder_goes_and_result_stays(spark):
    path = scratch_path(spark, "result")
    with scratch_folder(spark, "work"):
        step = scratch_path(spark, "step")
        rows = stash(spark.range(10), "step")
        inner = os.path.dirname(local(step))
        assert len(os.listdir(inner)) == 1
        with scratch_folder(spark, "nested"):
            doubled = stash(rows.select(F.col("id") * 2), "more", path)
        assert len(os.listdir(inner)) == 1
    assert not os.path.exists(inner) and doubled.count() == 10
    assert os.path.dirname(local(scratch_path(spark, "after"))) == local(checkpoint_root(spark))
    drop_scratch(spark, path)
    assert not os.path.exists(local(path))


def test_folder_stays_after_a_failure(spark):
    with pytest.raises(RuntimeError), scratch_folder(spark, "work"):
        rows = stash(spark.range(3), "step")
        raise RuntimeError
    assert rows.count() == 3


def test_nothing_else_is_deleted(spark, tmp_path):
    for path in (str(tmp_path), checkpoint_root(spark), f"{checkpoint_root(spark)}x"):
        with pytest.raises(ValueError):
            drop_scratch(spark, path)
    assert tmp_path.exists()
