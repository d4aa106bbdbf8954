"""Training-data operators: ten corpus-scale steps, each in a module of its own.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered
queries and their SQL; the modules hold the operators with their general interfaces.
"""
