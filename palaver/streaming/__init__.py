"""Structured Streaming forms: caption files as they come, requests per minute."""
