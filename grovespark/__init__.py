"""Collections inside documents as Spark columns: navigation, filtering, folding, set operations, text, numbers, partial
dates and quantities, over nested DataFrames in batch or stream.

A collection of any number of items is an array column without nulls; a collection of at most one item is a plain
column, null when empty. Every function builds ordinary column expressions, so Catalyst sees the whole query."""
