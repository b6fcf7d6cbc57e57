"""Where tables live: file systems and the version log."""
