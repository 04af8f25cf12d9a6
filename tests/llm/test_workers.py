"""What workers hold in memory while the stages of a pipeline follow each other in them."""

import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, decontam, records, tokens
from foliospark.llm.queries import tokenizer_path

pytest.importorskip("public_tokenizers")


def held(spark) -> int:
    """Stores and search tables that live in the workers while tasks of another operator run there."""

    def start():
        import gc

        return lambda b: {"n": [sum(isinstance(x, (tokens.Store, decontam.Search)) for x in gc.get_objects())] * len(b["id"])}

    return common.mapped(spark.range(64).repartition(8), start, ["id"], ["id"], "n int").agg(F.max("n")).first()[0]


def test_a_worker_drops_what_the_next_operator_does_not_need(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word', id, ' and some more of it') AS text").repartition(8)
    records.write_records(docs, f"file://{tmp_path}/records", tokenizer_path())
    assert held(spark) == 0
    items = spark.createDataFrame([("a", "word7 and some more of it")], "item_id string, text string")
    assert [r["doc_id"] for r in decontam.find_spans(docs, items).where("n_hit > 0").collect()] == [7]
    assert held(spark) == 0


def test_a_worker_keeps_one_thing_between_tasks():
    made = []
    make = lambda x: lambda: made.append(x) or x
    for x in ("a", "a", "b", "b", "a"):
        assert common.begun(lambda: common.worker_keeps(x, make(x))) == x
    assert made == ["a", "b", "a"] and list(common._kept) == ["a"]
    common.begun(lambda: None)
    assert not common._kept


class Spy:
    """A tokenizer that notes how many texts it is given at once."""

    def __init__(self, own):
        self.own, self.most = own, 0

    def encode_batch(self, texts, **more):
        self.most = max(self.most, len(texts))
        return self.own.encode_batch(texts, **more)

    def encode_batch_fast(self, texts, **more):
        self.most = max(self.most, len(texts))
        return self.own.encode_batch_fast(texts, **more)


@pytest.mark.parametrize("chunked", [True, False])
def test_the_library_is_given_few_texts_at_once(chunked):
    encode = records.Encoder(tokenizer_path(), chunked)
    plain = encode.tokenizer
    encode.tokenizer = spy = Spy(plain)
    texts = [" ".join(f"w{i}x{k}, Word-{i * k}" for k in range(40)) for i in range(300)] + ["", None, "Ελλάδα  <|x|> é\n"]
    got = encode(texts, 2)
    assert got == [encode.packed([*plain.encode(t or "", add_special_tokens=False).ids, 2]) for t in texts]
    assert 0 < spy.most <= 16
