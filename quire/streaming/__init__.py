"""Running operators on files and events as they arrive."""
