"""pulse: opinion analytics over short texts on Spark, in batch and as a stream.

Every operator is a function from DataFrame to DataFrame built from Spark's own
expressions, so Catalyst prunes, pushes down and codegens the whole plan.
"""

__version__ = "0.1.0"
