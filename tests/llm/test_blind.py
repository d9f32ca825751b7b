"""Precision and recall on cases that nothing was set by."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import blind  # noqa: E402


def test_blind_cases(spark):
    got = blind.measure(spark)
    print(got)
    assert all(p >= 0.9 and r >= 0.9 for p, r in got.values()), got
