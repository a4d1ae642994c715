"""Array expressions for n-gram windows, padding and contexts.  N-grams are
produced inside each row with ``transform`` + ``explode`` (no window shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramloom import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pad(col, n_bos: int, bos, eos=None) -> Column:
    """``[bos]*n_bos ++ tokens (++ [eos])``."""
    parts = [F.array_repeat(F.lit(bos), n_bos), _c(col)]
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts)


def ngram_structs(padded, n: int, names: list[str]) -> Column:
    """Array of structs, one per n-gram window of ``padded``, built by
    zipping ``n`` shifted slices (linear in the array length); empty when
    the array is shorter than ``n``.  ``padded`` should be a column already
    projected on its own, so its producer is evaluated once per row."""
    p = _c(padded)
    length = F.size(p) - (n - 1)
    zipped = F.arrays_zip(*[F.slice(p, j + 1, F.greatest(length, F.lit(0))) for j in range(n)])
    return F.when(F.size(p) >= n, F.transform(
        zipped, lambda z: F.struct(*[z[str(j)].alias(names[j]) for j in range(n)])
    )).otherwise(F.array())


def last_context(ctx, bos: int = K.BOS_ID) -> tuple[Column, Column]:
    """Last two ids, or (bos, bos) when fewer than two."""
    c = _c(ctx)
    enough = F.size(c) >= 2
    return (F.when(enough, F.element_at(c, -2)).otherwise(F.lit(bos)),
            F.when(enough, F.element_at(c, -1)).otherwise(F.lit(bos)))


def last_context_of(ctx) -> tuple[Column, Column]:
    """E6 of an array of tokens with an ``id``, looking at its end only."""
    c = _c(ctx)
    enough = F.size(c) >= 2
    return (F.when(enough, F.get(c, F.size(c) - 2)["id"]).otherwise(F.lit(K.BOS_ID)),
            F.when(enough, F.get(c, F.size(c) - 1)["id"]).otherwise(F.lit(K.BOS_ID)))


def last_id(ctx) -> Column:
    """The id of the last token (none: the start marker)."""
    c = _c(ctx)
    return F.coalesce(F.get(c, F.size(c) - 1)["id"], F.lit(K.BOS_ID))


def shard_of(w1, w2, num_shards: int) -> Column:
    """((w1 * 1000003) XOR w2) floor-mod n, on 64-bit integers."""
    x = (_c(w1).cast("bigint") * F.lit(K.SHARD_MULTIPLIER).cast("bigint")).bitwiseXOR(
        _c(w2).cast("bigint"))
    return F.pmod(x, F.lit(num_shards).cast("bigint")).cast("int")


def uniform01(*cols) -> Column:
    """Deterministic uniform in (0,1): the first 52 bits of the md5 of the
    columns joined by ``-``, centred.  Recomputation after a lost task yields
    the same draw, and any engine with md5 can repeat it."""
    digits = F.substring(F.md5(F.encode(F.concat_ws("-", *[c.cast("string") for c in cols]), "UTF-8")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def gumbel(*cols) -> Column:
    """Gumbel(0,1) noise: argmax(log w + g) draws index i with prob w_i/sum w."""
    return -F.log(-F.log(uniform01(*cols)))
