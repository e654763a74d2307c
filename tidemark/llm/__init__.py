"""Training-data operators: ten corpus-preparation steps on Spark.

Nothing else in the library imports this subpackage.
"""
