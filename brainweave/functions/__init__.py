"""brainweave package."""
