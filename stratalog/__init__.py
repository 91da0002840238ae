"""A Spark-native engine for versioned tables: SQL, change logs, audits."""
