"""Turnstone: dialogue-corpus analytics on Spark."""
