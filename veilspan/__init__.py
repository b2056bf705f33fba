"""Spark-native detection, review and removal of personal data in tables of documents."""
