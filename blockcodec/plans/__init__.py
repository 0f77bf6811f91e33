"""Plans that spread one value over many tasks."""
