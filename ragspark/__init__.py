"""ragspark: retrieval and question answering over large text tables, on Spark.

Sub-packages:

* ``sources``    readers with explicit schemas, positional scans, sharded and restartable sinks
* ``functions``  column expressions: text analysis, prompts, JSON line repair, vectors
* ``operators``  DataFrame-to-DataFrame operators: indexes, search, nearest neighbours, lookups
* ``plans``      compositions: the answering chain, question sets, evaluation
* ``streaming``  the unbounded form of the answering chain
* ``registry``   every operator bound to the shared test tables, with its SQL twin
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
