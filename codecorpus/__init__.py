"""codecorpus: Spark-native jobs over code corpora and assistant logs.

Each operator is a plain function ``DataFrame -> DataFrame`` built from
Spark SQL expressions; Arrow batch functions are used only where the
semantics are a sequential fold or an HTML tree walk.
"""

__version__ = "0.1.0"
