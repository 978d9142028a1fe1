"""Writers for findings."""
