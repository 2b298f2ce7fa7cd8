"""Marketing and customer analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from marketlens.plans.tables import Tables
from marketlens.session import build_session

# Functions sent to executors carry their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Tables", "build_session"]
