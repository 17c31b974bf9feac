"""Spark-native sketch containment, community-profile analytics and corpus operators."""
