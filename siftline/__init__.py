"""Incident text analytics as Spark jobs.

Pages become articles, articles become features and scores, relevant articles
become incidents, and incidents feed list, search and dashboard views.  Every
operator takes and returns DataFrames (or column expressions).
"""

__version__ = "0.1.0"
