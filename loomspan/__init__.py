"""loomspan: SQL lineage, task profiles and data-quality operators on PySpark.

Every operator takes and returns DataFrames.  Python code that runs on the executors is shipped by
value, so a cluster needs neither this package nor its path installed on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
