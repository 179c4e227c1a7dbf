"""sessionlake: sessionize activity event logs and query the sessions on Spark.

Every public function takes and returns a ``pyspark.sql.DataFrame``; nothing is
collected to the driver. See ``README.md`` for the operator map.
"""

from sessionlake.config import SessionConfig, get_spark, storage_root

__all__ = ["SessionConfig", "get_spark", "storage_root"]
