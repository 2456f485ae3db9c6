"""Operators for preparing training data: search, near duplicates, classifiers, licences, chat, tokens, decontamination."""
