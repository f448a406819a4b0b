"""Training-data operators: packing, toxicity, tokenizing, dedup, fingerprints, URL filters, PII, WARC,
prefix tries, fill-in-the-middle and nearest neighbours.

Nothing outside this package imports it.  Functions of this package that run in Python workers are pickled by
value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
