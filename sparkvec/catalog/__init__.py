from . import (  # noqa: F401
    coding, measures, records, retrieval, sampling, scalars, streams, training)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
