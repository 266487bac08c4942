"""Operators for preparing training text. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions that run in tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
