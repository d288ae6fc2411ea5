"""Output tables (monthly snapshots)."""
