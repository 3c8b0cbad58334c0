"""Functions of seqloom."""
