"""Training-data operators: mixing, joins, scans, classifiers, deduplication, formatting.

Nothing else in the library imports this subpackage; its queries are in ``llm.queries``.
"""

from pyspark import cloudpickle

import quillnest.llm as _own

# Functions of this subpackage travel to executors by value: they need no installed package there.
cloudpickle.register_pickle_by_value(_own)
