"""Training-data operators (language id, URL rules, tokenisation, dedup, decontamination, ...).

Nothing else in the library imports this subpackage.
"""
