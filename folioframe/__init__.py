"""Folioframe: page-layout and training-corpus analytics as plain PySpark DataFrame jobs."""
