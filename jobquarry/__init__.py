"""jobquarry: job-posting extraction, curation and vector search as Spark jobs."""

import sys

from pyspark import cloudpickle

from jobquarry.config import PatternConfig, load_patterns
from jobquarry.session import build_session, scratch_path

# Python workers get the page functions along with the job that uses them, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PatternConfig", "build_session", "load_patterns", "scratch_path"]
