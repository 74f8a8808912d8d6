"""Sources: relations and dependency files."""
