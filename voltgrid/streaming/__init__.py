"""No streaming operators: every input of the surveyed source is a finished file or log.

The event-log functions in ``voltgrid.operators.events`` take plain DataFrames, so a caller may apply the
aggregating ones inside ``foreachBatch``.
"""
