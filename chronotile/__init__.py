"""chronotile: land-change analytics over map tiles, expressed as Spark DataFrame jobs.

Every step is a function ``DataFrame -> DataFrame`` built from the public PySpark API.
"""

from chronotile.params import Params

__all__ = ["Params"]
