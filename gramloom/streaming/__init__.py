from gramloom.streaming.partials import stream_partial_counts, write_corpus_files  # noqa: F401
