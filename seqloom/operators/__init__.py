"""Operators of seqloom."""
