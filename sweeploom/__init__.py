"""Parametric response analytics on Spark.

Every public function takes DataFrames and returns DataFrames; options are
keyword arguments.  See README.md for the map of modules.
"""

__version__ = "0.1.0"
