"""Analytics over AI-agent interaction logs, expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from agentlog.config import Settings

# Functions that run in tasks carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
