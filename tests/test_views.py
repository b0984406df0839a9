"""Adapter views: how they are dealt out."""

import os

import pytest

from waymark.plans import views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


def test_trajectories_get_tasks_by_their_events(spark, monkeypatch):
    monkeypatch.setattr(views, "STEPS_A_TASK", 10)
    n = views.table(spark, DATA, "events").count()
    steps = views.trajectory(spark, DATA)
    assert steps.rdd.getNumPartitions() == -(-n // 10) > 4
    assert steps.count() == n
