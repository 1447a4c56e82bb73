"""Venue discovery, entity resolution and ranking as Spark jobs.

Sightings of places go in; canonical places, scores per category, run-to-run
changes and served lists come out.  Everything is a DataFrame plan: functions
build Columns, operators take and return DataFrames, plans compose them.
"""

__version__ = "0.1.0"
