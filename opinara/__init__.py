"""Review analytics as Spark jobs.

The package is split by the role a module plays in a job:

``sources``    reading, column-role mapping, sampling and table storage
``functions``  column expressions (text, dates, numbers, dictionaries)
``operators``  DataFrame -> DataFrame steps (cleaning, star build, rollups, ranking, text statistics)
``plans``      the analytic queries, composed from the above
"""

__version__ = "0.1.0"
