"""Plans of seqloom."""
