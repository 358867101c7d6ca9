"""Palimpsest: a bi-temporal memory and retrieval engine expressed as Spark plans.

Every operator takes DataFrames and returns DataFrames; nothing here collects
rows of a growing table to the driver.  ``palimpsest.llm`` holds the
training-data operators and is optional: no module outside it imports it.
"""

__version__ = "0.1.0"
