"""Training-data operators: ten components over documents, pages, conversations and vectors.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
