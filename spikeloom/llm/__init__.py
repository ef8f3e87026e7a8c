"""Training-data operators: ten text operators, their queries and their SQL twins.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
