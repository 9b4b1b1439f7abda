"""Training-data pipeline operators: quality, packing, near-duplicates, chat,
decontamination, URL reputation, language, toxicity, neighbours, LM scoring,
token store, centroid clustering, token alignment.

One module per operator; ``queries`` registers the ``opN_*`` queries and the
pipeline.  Nothing outside this package imports it.
"""
