"""quireflow: a document analytics and retrieval engine on PySpark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Functions travel to the executors with their code, so the package needs to be installed on the driver only.
register_pickle_by_value(sys.modules[__name__])
