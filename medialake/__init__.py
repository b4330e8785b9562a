"""medialake: a PySpark-native analytics engine for media catalogues."""
