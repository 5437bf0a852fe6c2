"""Readers and writers for the job tables, upload sheets and the sample views."""
