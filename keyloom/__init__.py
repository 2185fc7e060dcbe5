"""keyloom: JSON path profiling and dynamic-key detection as Spark jobs.

Every public function takes DataFrames and returns a lazy DataFrame; nothing is
collected to the driver and no group is gathered into one task.
"""

from keyloom.session import configure

__all__ = ["configure"]
