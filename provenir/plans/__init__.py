"""Case tables over relational inputs, and the catalogue of queries."""
