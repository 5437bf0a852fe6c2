"""The named queries over the sample tables and the SQL their results are checked by."""
