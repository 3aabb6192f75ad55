"""Training-data operators: search, tokenising, mixing, language, URL, chat, quality and dedup.

Nothing outside this subpackage imports it; its queries are in ``lodestone.llm.queries``.
"""
