"""Training-data operators: ten corpus operators and the pipeline built from them.

Nothing outside this subpackage imports it.
"""
