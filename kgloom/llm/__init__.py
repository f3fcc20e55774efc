"""Training-data operators: one module per operator, `registry` holds their queries and SQL.

Nothing else in the library imports this subpackage.
"""
