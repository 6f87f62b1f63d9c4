"""DataFrame operators: search, codecs, clustering, evaluation."""
