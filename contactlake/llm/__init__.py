"""Training-data operators (secrets, LM scoring, decontamination, quality,
line and document dedup, suffix dedup, BPE, PII, edit-aware token counts,
packing, hard negatives, importance resampling).

Nothing else in the library imports this subpackage.  Functions that run
inside Spark's Python workers are pickled by value, so workers need no copy
of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
