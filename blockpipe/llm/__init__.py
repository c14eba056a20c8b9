"""Operators for large-scale training data: search, sharding, archives,
classifiers, near duplicates, URL filters, packing, licences, decontamination.

Nothing else in the library imports this subpackage. Code that runs inside
Python workers is sent along with the query (pickled by value), so executors
need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
