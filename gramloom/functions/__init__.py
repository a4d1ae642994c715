from gramloom.functions.text import (  # noqa: F401
    strip, normalize_line, strip_symbols, clean_piece, is_cacheable_piece,
    is_word_like, valid_prompt, split_lines, word_tokens, char_tokens,
)
from gramloom.functions.arrays import (  # noqa: F401
    pad, ngram_structs, last_context, shard_of, uniform01, gumbel,
)
