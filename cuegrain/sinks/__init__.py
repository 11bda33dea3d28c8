"""Writers of files."""
