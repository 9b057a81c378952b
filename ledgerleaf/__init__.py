"""Spark-native document analytics: normalise, extract, validate and register documents at table scale."""
