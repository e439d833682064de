"""Corpus transformation with language models, as Spark jobs.

Scan a source tree, route files, cut what exceeds a model's budget into pieces,
attach known examples, ask a provider, put the replies back together and write
one renamed output per source, all as DataFrame operators.
"""
