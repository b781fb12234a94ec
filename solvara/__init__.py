"""Solvara: corporate-distress and credit-risk analytics as PySpark DataFrame operators."""
