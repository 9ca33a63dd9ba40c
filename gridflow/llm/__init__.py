"""Operators for training data at scale; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# tasks receive these modules with the job, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
