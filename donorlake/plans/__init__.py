"""Task graphs and the catalogue of registered queries."""
