"""Fixed values that results depend on.

These are the literal values of the n-gram toolkit being re-implemented
(sentinel ids, characters removed by line normalisation, the particle set of
the word test, request defaults).  They are stated once here, in natural
order, and referenced everywhere else.
"""

# --- fixed values: sentinel token ids of the id-keyed models -----------------
BOS_ID = -1
EOS_ID = -2

# --- fixed values: sentinel pieces of the string-keyed bigram model ----------
BOS_PIECE = "<BOS>"
EOS_PIECE = "<EOS>"

# --- fixed values: reserved vocabulary rows (ids 0, 1, 2) ---------------------
UNK_PIECE = "<unk>"
CONTROL_PIECES = ("<s>", "</s>")
UNK_ID = 0
# Text that decoding the unknown id yields (U+2047, later removed as a symbol).
UNK_SURFACE = "⁇"

# --- fixed values: word-boundary marker of subword pieces --------------------
SPACE_MARK = "▁"

# --- fixed values: characters deleted by line normalisation ------------------
NORMALIZE_DELETE = "。、「」『』"

# --- fixed values: short texts that always count as a word -------------------
SINGLE_CHAR_WORDS = (
    "が", "を", "に", "へ", "と", "で", "は", "も", "や", "か", "の", "な",
    "ね", "よ", "ぞ", "さ", "た", "だ", "し", "て", "から", "まで",
)

# --- fixed values: context-hash sharding --------------------------------------
SHARD_MULTIPLIER = 1000003
DEFAULT_NUM_SHARDS = 64
SHARD_FORMAT = "trigram-sharded-v1"

# --- fixed values: training and generation defaults --------------------------
DEFAULT_LINES_PER_CHUNK = 100000
DEFAULT_VOCAB_SIZE = 32000

GEN_MAX_TOKENS = 80
GEN_TOP_K = 8
GEN_TEMPERATURE = 0.95
GEN_MIN_LEN_BEFORE_EOS = 32
CACHE_ALPHA = 0.18
CACHE_RECENT_WINDOW = 48

EOS_EARLY_FACTOR = 0.03
EOS_LATE_FACTOR = 0.5
MIN_WEIGHT = 1e-8
MIN_TEMPERATURE = 1e-5
MIN_PROBABILITY = 1e-12

TREE_MAX_DEPTH = 5
TREE_BRANCH_FACTOR = 2
TREE_MAX_SUBTOKENS_PER_WORD = 4
TREE_CSV_BUCKETS = 64
TREE_ROOT_PIECE = "<ROOT>"

NEURAL_CONTEXT_SIZE = 4
NEURAL_EMBED_DIM = 128
NEURAL_HIDDEN_DIM = 256
NEURAL_DROPOUT = 0.2
NEURAL_BATCH_SIZE = 256
NEURAL_EPOCHS = 3
NEURAL_LR = 1e-3
NEURAL_SEED = 42

REJECT_REASON_PROMPT = "prompt must be a non-empty string"
