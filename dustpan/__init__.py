"""Find and remove waste in large file stores, expressed as Spark jobs.

A store is a table with one row per file or directory.  Every question about
it (leftovers, copies, near copies, empty directories, work estimates) is a
DataFrame operation; acting on an answer is a separate, re-checked step.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Task functions travel with the job: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
