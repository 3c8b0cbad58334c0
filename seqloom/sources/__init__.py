"""Sources of seqloom."""
