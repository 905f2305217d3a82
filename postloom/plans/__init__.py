"""Runnable queries over the supplied tables, each with the SQL that checks it."""
