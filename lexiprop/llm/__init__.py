"""Training-data operators: quality rules, token files, duplicate removal, encoding,
toxicity, mixing, sharding, quality classification and personal data.

Nothing outside this subpackage imports it.
"""
