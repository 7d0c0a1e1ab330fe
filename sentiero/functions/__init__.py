"""Part of the sentiero engine."""
