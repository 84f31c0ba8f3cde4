"""Corpus-quality and speech-evaluation analytics on PySpark."""
