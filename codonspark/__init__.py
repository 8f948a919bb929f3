"""Spark jobs for comparative codon data: alignments, trees, posterior traces, sufficient statistics."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
