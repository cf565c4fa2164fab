"""Subtitle and OCR quality analytics as Spark jobs over many episodes."""
