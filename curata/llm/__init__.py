"""Training-data operators: search, tokenising, near duplicates, filtering, scanning.

One module per operator; ``queries`` holds the registry of their queries and SQL.
Nothing else in the library imports this package.
"""
