"""Live views of growing chains."""
