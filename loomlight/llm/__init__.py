"""Operators that prepare text corpora for the training of language models.

Functions of this package that run in tasks travel with the tasks, so executors need
not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
