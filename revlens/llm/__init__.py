"""Training-data operators: toxicity, license scan, language ID, near-dedup,
decontamination, line dedup, exact top-k search, substring dedup, BPE, WARC, exact
Jaccard join, filter interaction audit, hard negatives.

Nothing else in the library imports this package; its queries are in
``revlens.llm.catalog`` and are added by ``__spark_entry__`` when it is present.
Executors need the package on their path (installed, or ``--py-files``).
"""
