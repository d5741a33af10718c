"""medialens: a Spark-native analytics engine for large media libraries."""
