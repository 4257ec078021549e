"""Structured Streaming forms of the rollout operators (an extension)."""
