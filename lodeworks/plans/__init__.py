"""The query language, its compiler and runner, and the catalogue of registered queries."""
