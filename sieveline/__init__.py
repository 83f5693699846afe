"""A PySpark-native engine that scans tables of text and bytes for leaked credentials."""
