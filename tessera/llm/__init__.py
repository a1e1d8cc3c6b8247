"""Training-data operators: quality rules, suffix dedup, packing, line dedup,
toxicity, subword pieces, chat windows, near-duplicate sketches, fingerprints,
directly addressable token files, lexical search, a quality classifier and a
source divergence audit.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
