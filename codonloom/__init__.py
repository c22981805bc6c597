"""Spark-native codon-evolution analytics."""
