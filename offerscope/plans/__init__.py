"""End-to-end plans and the catalogue of named queries."""
