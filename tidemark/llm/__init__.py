"""Training-data operators: filters, scans, dedup, decontamination, mixing.

Nothing else in the package imports this subpackage.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
