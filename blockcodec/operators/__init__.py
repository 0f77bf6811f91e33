"""The inner structure of blocks and streams as tables."""
