"""treeflow: a PySpark-native analytics engine for file-tree replication data."""
