from gramloom.sources.lines import (  # noqa: F401
    read_table, spread, doc_lines, read_lines, read_text_files, clean_lines, valid_doc_lines,
    key_offsets, indexed_lines, limit_lines, corpus_lines,
)
