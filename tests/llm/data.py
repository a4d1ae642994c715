"""Small tables with the awkward cases: nulls, empty and long texts, ties,
repeated rows, and extra columns whose names clash with the operators' own."""
import random

CLASH = "fp long, row long, h long, words long, kept long, blob string, text_hash long, cuts long, w long, i long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def prose(rng, n, size=400):
    words = ["w%d" % rng.randrange(size) for _ in range(n)]
    out, k = [], 0
    while k < len(words):
        m = rng.randrange(5, 15)
        out.append(" ".join(words[k:k + m]).capitalize() + ".")
        k += m
    return "\n".join(" ".join(out[j:j + 3]) for j in range(0, len(out), 3))


def texts(seed=0, n=40):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(60, 300)) for _ in range(n)]
    near = [t + " Last word." for t in base[:5]]
    return [None, "", " \t\n", "one", "two words", *base, *near, base[0], base[1], "ÀÉ ß İ Σ 日本 é x" * 3,
            prose(rng, 20000)]


def documents(spark, rows, ids=None):
    ids = list(range(len(rows))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[0] * 5, "b", 0, 0, 0, 0)
                                  for i, t in zip(ids, rows)], SCHEMA)


def awkward(spark, seed=0):
    """Documents with a repeated row, a null id and two texts of one id."""
    t = texts(seed)
    ids = list(range(len(t)))
    return documents(spark, [*t, t[5], "no id here", t[7], "other text of id six"], [*ids, 5, None, None, 6])


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)
