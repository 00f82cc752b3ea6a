"""rankloom: two-stage recommendation and ranking analytics as Spark jobs.

Every operator takes and returns DataFrames; nothing data-sized is collected
to the driver. See README.md for the operator map.
"""

__version__ = "0.1.0"
