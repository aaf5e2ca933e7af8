"""Operators of a training-data pipeline over documents, pages and embeddings. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the workers whole, so that clusters need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
