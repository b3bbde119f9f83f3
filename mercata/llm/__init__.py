"""Training-data operators: filtering, mixing, near-duplicates, scans and extraction.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Its functions travel to
Python workers by value, so executors need the libraries it uses but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
