"""Training-data operators on document tables: quality rules, near duplicates, decontamination, mixing, token files and more.

Nothing outside this package imports it. ``queries.py`` registers one query per operator, ``oracles.py`` their SQL twins.
"""
