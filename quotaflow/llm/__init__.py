"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this folder imports it; the library works without it.
"""
