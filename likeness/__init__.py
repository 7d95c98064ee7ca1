"""Set-based identity resolution on Spark: has this person been seen before?

Every public function takes and returns a ``DataFrame`` or a ``Column``; none
creates a session, reads the clock or keeps global state.
"""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so the package needs to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
