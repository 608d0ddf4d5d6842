"""storyline: article feeds to a de-duplicated, event-resolved, ranked digest, as DataFrame-to-DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the executors by value, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
