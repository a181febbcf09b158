"""The views over the given tables keep every row of them, whatever their size."""

import os

import pytest
from pyspark.sql import functions as F

from meterloom.plans.adapters import Tables

FOLDER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_devices_and_passes_grow_with_their_tables(spark):
    t = Tables(spark, FOLDER)
    assert t.devices.count() == t.source("supplier").count() > 20
    assert t.view("login_passes").count() == t.source("customer").count() > 500
    used = t.requests.where("device_id is not null").select(F.col("device_id").alias("id")).distinct()
    assert used.join(t.devices, "id", "left_semi").count() > 24  # machines in use grow with the events
    assert used.join(t.devices, "id", "left_anti").count() > 0  # removed machines
    roots = t.view("landed_lines").select("root").distinct()
    assert roots.count() > 6 and roots.join(t.view("login_passes"), "root", "left_anti").count() == 0
