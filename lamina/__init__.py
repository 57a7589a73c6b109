"""lamina: a layered (bronze / silver / gold) analytics engine written as Spark plans.

Every operator is a function from DataFrames to a DataFrame.  Clocks and run
identifiers are arguments, never read inside an operator, so a plan gives the
same rows each time it is evaluated.
"""
