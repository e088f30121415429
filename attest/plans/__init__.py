"""Task specifications compiled to plans, and the catalogue of registered queries."""
