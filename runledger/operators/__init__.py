"""Dashboards, searches, schedule work, table changes and upload checks.

Every function takes DataFrames, or the set of job tables, and returns DataFrames;
nothing is computed until the caller writes or shows the result.
"""
