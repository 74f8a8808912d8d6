"""Entry points, reports, fixtures and registered queries."""
