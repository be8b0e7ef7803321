"""DataFrame operators: curation, deduplication, evaluation, retrieval, segmentation, sessions."""
