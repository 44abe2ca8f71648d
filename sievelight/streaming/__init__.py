"""Row-local checks on files as they arrive."""
