"""Training-data operators: packing, URL rules, near-dedup, BPE, media, chat, PII, fingerprints, HTML, quality.

Nothing else in the library imports this subpackage.
"""
