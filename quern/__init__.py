"""quern: composable Spark operators for log, click and activity data.

Everything is a function from DataFrames to a DataFrame; Catalyst plans the work.
Functions that run inside Python workers are shipped by value, so a cluster needs
no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
