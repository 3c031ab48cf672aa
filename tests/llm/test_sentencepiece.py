import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.sentencepiece_bpe import Encoder, encode_decode, model_bytes, public_model


@pytest.fixture(scope="module")
def encoder():
    return Encoder(model_bytes(public_model()))


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "▁", "a▁b", "a ▁ b", "\0", "漢字 ﬁ😀", "a" * 3000, "ab" * 1500, " " * 300, "the" * 2000, "Hello, world!\n\tNext"])
def test_equals_the_library(encoder, text):
    assert encoder.encode(text)[0] == encoder.library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(encoder, text):
    ids, said = encoder.encode(text)
    assert ids == encoder.library.encode(text)
    assert said == ",".join(map(str, ids))


def test_backtracking_equals_merging(encoder):
    r = random.Random(7)
    for _ in range(2000):
        text = "▁" + "".join(r.choice("abcdehinorstéü") for _ in range(r.randint(1, 24)))
        merged = [encoder.ids[p] for p in encoder.merged(text)]
        assert encoder._backtracked(text) == merged == encoder._segment(text)


def test_caches_do_not_change_results(encoder, monkeypatch):
    from tallyspark.llm import sentencepiece_bpe

    monkeypatch.setattr(sentencepiece_bpe, "CHUNKS", 3)
    monkeypatch.setattr(sentencepiece_bpe, "PAIRS", 3)
    fresh = Encoder(model_bytes(public_model()))
    for text in ["one two three four five six one two", "seven one eight nine ten one"]:
        assert fresh.encode(text)[0] == fresh.library.encode(text)


def test_odd_rows(odd, encoder):
    got = encode_decode(odd, public_model()).collect()
    assert len(got) == odd.count()
    for r in got:
        want = encoder.library.encode(r.text or "")
        assert r.token_ids == want and r.n_tokens == len(want) and r.decoded == encoder.library.decode(want)
    assert encode_decode(odd.limit(0), public_model()).count() == 0


def test_a_worker_lets_go_of_the_encoder(spark):
    """Kept by the worker's process, caches of hundreds of MB stay beside what later stages need."""
    from pyspark.sql import functions as F

    @F.udf("int")
    def alive(_):
        import gc
        import time

        time.sleep(0.5)  # so that all workers are asked
        return sum(type(x).__name__ == "Encoder" and hasattr(x, "automaton") for x in gc.get_objects())

    rows = spark.range(0, 64, 1, 8)
    assert encode_decode(rows.selectExpr("cast(id as string) text"), public_model()).count() == 64
    assert encode_decode(rows.selectExpr("cast(id as string) text"), public_model()).agg(F.sum("n_tokens")).first()[0] > 64
    assert [r[0] for r in spark.range(0, 8, 1, 8).select(alive("id")).collect()] == [0] * 8
