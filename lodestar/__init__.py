"""A Spark library for matching people and projects, and for what is computed around that."""
