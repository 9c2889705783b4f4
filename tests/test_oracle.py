"""Every registered query against its SQL on the same tables."""

import functools
import warnings

import pytest

import oracle
from sparkvec.catalog import ORACLES, QUERIES

warnings.filterwarnings("ignore")


@functools.cache
def _connection(sf_dir):
    return oracle.connect(sf_dir)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        want = _connection(sf_dir).execute(ORACLES[name]).df()
        assert oracle.difference(got, want) is None
