"""policylens: decision-log ETL, off-policy evaluation and batch policy learning on PySpark.

Everything is a DataFrame transformation.  See README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
