"""Reads over fact tables: temporal, index pages, pull, search, schema."""
