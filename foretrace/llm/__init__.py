"""Training-data operators: tokenizing, search, redaction, de-duplication, archives, chat, quality.

Nothing outside this subpackage imports it.
"""
