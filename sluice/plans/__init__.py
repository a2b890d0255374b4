"""Adapters from the star-schema tables to fact tables, and the registered queries."""
