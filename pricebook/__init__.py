"""pricebook: price comparison of the same item across many sellers, as Spark jobs.

Every public function takes and returns DataFrames or Columns.  The current
time, run ids and settings are always arguments, never read from the clock.
"""

__version__ = "0.1.0"
