"""No stream operators of its own.

``annotate_sentences``, ``annotate`` and the span and tag operators work row by row, so they take a
``readStream`` frame as it is. Everything with document-wide or corpus-wide counts is a batch job.
"""
