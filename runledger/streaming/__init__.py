"""The same table work on growing inputs, with Structured Streaming.

Every query here takes an input stream and an output folder. Batches are written
below a path named by their number and overwrite it when run again, so a batch that
is repeated after a failure changes nothing.
"""
