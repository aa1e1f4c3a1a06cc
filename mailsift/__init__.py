"""mailsift: PySpark jobs that build, train, judge and run phishing-mail detectors."""

import sys

from pyspark import cloudpickle

# UDFs travel with their helpers, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
