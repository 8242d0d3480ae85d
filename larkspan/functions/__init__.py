"""Part of the larkspan engine."""
