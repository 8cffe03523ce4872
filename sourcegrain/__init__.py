"""sourcegrain: corpus intelligence over code and text, written as Spark jobs.

Every operator takes DataFrames and returns a DataFrame keyed by ``repo_id`` (and mostly by
``path``), so one job covers any number of repositories at once.
"""

__version__ = "0.1.0"
