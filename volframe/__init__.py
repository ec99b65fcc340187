"""volframe: Spark-native preparation and analysis of 3-D image collections."""
