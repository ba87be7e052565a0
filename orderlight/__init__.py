"""Order-risk analytics on Spark DataFrames.

``sources``    reading and writing items, snapshots, ledgers and model records
``functions``  column expressions (cleaning, features, economics, labels, currency)
``operators``  DataFrame -> DataFrame building blocks
``plans``      jobs that compose operators (ingest, scoring, training, retraining)
``streaming``  Structured Streaming jobs
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
