"""nearfield: vector collections, exact and approximate search, retrieval
evaluation, benchmark statistics and embedding extraction as PySpark plans."""

from pyspark import cloudpickle as _cloudpickle

import nearfield as _self

# Functions of this package that run inside Spark tasks (Arrow scorers,
# UDFs, embedders) are shipped with the task by value, so executors need no
# installed copy of the package.
_cloudpickle.register_pickle_by_value(_self)

__version__ = "0.1.0"
