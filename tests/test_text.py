"""Golden rows for the text functions."""
from pyspark.sql import functions as F

from gramloom.functions import text as T


def one_col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_normalize(spark):
    vals = ["　「東。京、都」　", "。、『』", "\u0009a。 ", "「 a 」", "a！b"]
    assert one_col(spark, vals, T.normalize_line) == ["東京都", "", "a", "a", "a！b"]


def test_strip_matches_python(spark):
    ws = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    vals = [ws + "x" + ws, "\u001cy\u001f", "​z"]
    assert one_col(spark, vals, T.strip) == [v.strip() for v in vals]


def test_strip_symbols(spark):
    assert one_col(spark, ["▁Hello, 世界! $5 + ①", "<EOS>"], T.strip_symbols) == ["Hello 世界 5  ①", "EOS"]


def test_word_like(spark):
    vals = ["", "が", "東", "東京", "7", "ー", " ", "́", "a"]
    assert one_col(spark, vals, T.is_word_like) == [False, True, False, True, False, False, True, True, False]


def test_cacheable(spark):
    df = spark.createDataFrame([(5, "▁"), (6, "▁,"), (7, "▁the"), (0, "<unk>"), (-1, "x"), (-2, "y")],
                               "id int, piece string")
    got = [r[0] for r in df.select(T.is_cacheable_piece(F.col("piece"), F.col("id"))).collect()]
    assert got == [False, False, True, True, False, False]


def test_valid_prompt(spark):
    df = spark.createDataFrame([("",), ("   ",), (None,), ("東京",)], "p string")
    assert [r[0] for r in df.select(T.valid_prompt(F.col("p"))).collect()] == [False, False, False, True]


def test_prefixes_of_a_line_are_cut_into_words_once(spark):
    """Every prefix with its words, linear in the line: a line of 6,000 words would take minutes prefix by prefix."""
    from gramloom.operators.vocab import prefix_rows
    texts = ["a", " ab  c\u3000\u3000d\x85 ", "\t ", "", None, "\U0001d49c\U0001d49e \u00e9e\u0301 x", "ab " * 6000]
    df = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "k int, line string")
    got = sorted(((r.k or 0, r.plen, r.prefix, r.n_tokens, r.last_token) for r in prefix_rows(df, ["k"]).filter("k is null or k < 6").collect()))
    want = [(k, i, t.strip()[:i], len(t.strip()[:i].split()), t.strip()[:i].split()[-1])
            for k, t in enumerate(texts[:6]) if t for i in range(1, len(t.strip()) + 1)]
    assert got == sorted(want)
    last = prefix_rows(df, ["k"]).filter("k = 6").selectExpr("count(*) n", "sum(n_tokens) s", "max(plen) m").first()
    assert tuple(last) == (17999, 3 * 6000 * 6001 // 2 - 6000, 17999)
