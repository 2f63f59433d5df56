"""End-to-end pipelines and the catalog of registered queries."""
