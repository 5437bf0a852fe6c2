"""Operators for large text collections: training-data work beside the job-run analytics.

Nothing outside this package imports it.
"""
