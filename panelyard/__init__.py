"""Entity x date panel analytics as plain DataFrame -> DataFrame functions on Spark.

The spine is one tidy shape, ``(date, entity, variable, value)`` plus optional
labels such as ``source``.  Every operator takes the column names it works on, so
the same code serves countries, suppliers, customers or users.
"""
