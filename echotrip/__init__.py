"""Round-trip translation analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions inside the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
