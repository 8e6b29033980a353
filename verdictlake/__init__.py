"""A Spark-native library for evaluating automated judges of language-model answers."""
