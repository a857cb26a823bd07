"""Training-data pipeline operators (packing, filtering, scoring, joins, search).

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
