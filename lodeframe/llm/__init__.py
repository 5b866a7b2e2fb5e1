"""Training-data operators over text, embedding and conversation tables.

Each module holds one operator with its own general interface; ``queries`` holds the thin
query adapters and their SQL.  Nothing else in the library imports this subpackage.
"""
