"""Spark jobs that turn nested API documents, inventory feeds and pages into typed node and edge tables, and audit and search them."""
