"""Training-data operators: language ID, exact search, dedup, tokens, sharding, mixing, chat.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns DataFrames; see each module's docstring for the treatment of nulls,
empty texts, repeated rows and empty tables.
"""
