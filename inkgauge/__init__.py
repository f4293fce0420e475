"""Stylometric analytics over document corpora, expressed as Spark plans."""
