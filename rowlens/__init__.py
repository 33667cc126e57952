"""Tables made searchable by meaning, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions travel with the tasks that run them; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
