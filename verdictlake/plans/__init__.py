"""Views over the star schema and the registered queries."""
