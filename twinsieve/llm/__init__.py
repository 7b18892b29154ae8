"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from pyspark import cloudpickle

from . import common

# Functions travel to the executors by value, so that these need no copy of this package.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["common"]))

__all__ = ["common"]
