"""gridspark: preparing gridded fields and verifying forecasts as Spark DataFrame jobs.

A *grid table* has one row per ``(time, iy, ix)`` cell and one column per variable; an absent or
missing value is NULL.  Every public function takes and returns lazy DataFrames.
"""

__version__ = "0.1.0"
