"""Structured Streaming: reductions lifted to streams, with watermarks and windows as a Spark extension."""
