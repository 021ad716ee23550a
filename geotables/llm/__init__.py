"""Operators for preparing training text: deduplication, decontamination, quality, language, tokens, chat, pages, vectors."""
