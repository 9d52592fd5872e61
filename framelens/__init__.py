"""Multimodal retrieval analytics as DataFrame-to-DataFrame operators on Spark."""
