"""Training-data operators (quality, secrets, packing, chat, tokens, LM scores, search, near-duplicates).

Nothing outside this subpackage imports it; ``registry`` lists its queries and SQL.
"""
