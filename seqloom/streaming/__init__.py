"""Streaming of seqloom."""
