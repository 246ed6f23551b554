"""tessera: occurrence-graph and vector-neighbourhood analytics as PySpark DataFrame operators."""
