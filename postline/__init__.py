"""postline: a Spark-native job-posting lifecycle engine.

Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column``
function built from ``pyspark.sql.functions``; Python runs only inside
Arrow-batched ``mapInPandas`` / ``pandas_udf`` helpers where the built-ins
cannot express the semantics (HTML card extraction, RFC822 parsing,
Python-literal formatting).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python helpers that run inside tasks (mapInPandas / pandas_udf) are
# shipped by value with the task, so executors need no installed copy of
# this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from postline.session import get_session, checkpoint_dir  # noqa: E402

__all__ = ["get_session", "checkpoint_dir"]
