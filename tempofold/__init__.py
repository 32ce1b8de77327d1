"""Product-event, content-identity, motion time-series and evaluation operators for Spark.

Every operator takes DataFrames and returns a DataFrame. Nothing here starts an
action except the sinks in ``tempofold.sources`` and the round loops that say so.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with their code, so workers need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
