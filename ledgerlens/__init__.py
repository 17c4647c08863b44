"""Corpus-scale analytics of tabular public-finance reports on PySpark."""
