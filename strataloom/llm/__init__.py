"""Training-data operators: near and exact duplicates, tokenised output, archives, scans, scores, mixing and packing.

Nothing else in the library imports this subpackage.  Each module has one
operator with a general interface; :mod:`strataloom.llm.queries` derives the
registered queries from them.
"""
