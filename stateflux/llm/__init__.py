"""Training-data operators: dedup, language ID, quality, tokenisation, packing, search, WARC and licence scans.

Nothing outside this subpackage imports it.
"""
