"""Structural analytics over large corpora, expressed as Spark DataFrame plans."""
