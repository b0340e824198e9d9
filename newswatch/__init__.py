"""A Spark-native news-intelligence warehouse.

Every operator is a plain function from DataFrames to a DataFrame. Reporting
time is always the explicit ``as_of`` parameter, so results are repeatable.
"""

import sys

from pyspark import cloudpickle

# The few Python functions run in tasks travel with the job: executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
