"""PySpark-native store and query engine for sequencing reads, with corpus tools."""
