"""Training-data pipeline operators (deduplication, filtering, scanning, mixing).

Nothing outside this package imports it; ``textlake/llm/queries.py`` lists the
queries that ``__spark_entry__.py`` adds when the package is present.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
