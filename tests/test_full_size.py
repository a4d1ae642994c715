"""The registered learning queries run in full size (recorded, not run)."""
import pytest

from gramloom import constants as K
from gramloom.operators import subword as SW
from gramloom.plans import queries as Q
from tests.conftest import SF_SMALL


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["subword_vocab", "subword_tokens", "subword_coverage", "subword_trigram_counts"])
def test_subword_queries(spark, monkeypatch, name):
    def train(lines, vocab_size=None):
        raise Seen(vocab_size)
    monkeypatch.setattr(SW, "train_unigram", train)
    with pytest.raises(Seen) as seen:
        Q.queries()[name](spark, SF_SMALL)
    assert seen.value.args == (K.DEFAULT_VOCAB_SIZE,)
