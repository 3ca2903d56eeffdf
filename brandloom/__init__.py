"""A PySpark-native engine that audits product-name namespaces."""
