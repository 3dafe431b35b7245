"""Token-grid analytics as Spark plans."""
