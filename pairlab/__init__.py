"""Spark-native operators for building, auditing and evaluating labelled query-candidate data."""
