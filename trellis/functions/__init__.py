"""Functions on attribute sets."""
