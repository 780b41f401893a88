"""gridloom: a Spark-native engine for document-table reconstruction, scoring and corpus work."""
