"""Sentiment mining of short social-media texts as Spark DataFrame operators."""
