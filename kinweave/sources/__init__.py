"""Readers that turn files and tables into source-tagged raw records."""
