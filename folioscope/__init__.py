"""Document retrieval and question answering as Spark DataFrame jobs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# The functions shipped to Python workers live in this package.  Pickling them by
# value lets a job run on executors that do not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
