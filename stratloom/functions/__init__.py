"""stratloom."""
