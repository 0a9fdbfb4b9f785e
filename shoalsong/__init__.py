"""Acoustic embedding analytics as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions of this package travel to the workers by value, so a job runs
# from any working directory without the package being installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
