"""Training-data operators: whole-corpus text and vector operators on Spark.

Nothing else in the package imports this subpackage.
"""
