"""Reading source files and keeping snapshots."""
