"""Training-data operators: thirteen corpus-scale jobs on documents, embeddings, pages and labels.

Nothing outside this subpackage imports it.
"""
