"""Ten operators of a training-data pipeline over ``documents``.

Nothing else in the library imports this subpackage. ``registry`` holds the
queries and their SQL.
"""
