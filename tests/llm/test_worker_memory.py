"""What Python workers keep from task to task."""

import corpus_pipeline as C
from foliant.llm.packing import pack_documents
from foliant.llm.queries import tokenizer_path
from foliant.llm.words import WordEncoder, encode_texts


def test_the_pipeline_packs_with_a_small_word_table(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('word', id, ' other', id, ' same') AS text").repartition(1)
    path, asked = tokenizer_path("word_bpe_49k.json"), []
    monkeypatch.setattr(C, "pack_documents", lambda *args, **named: asked.append(named["words"]) or pack_documents(*args, **named))
    packed = C.packing(spark, docs, "").collect()
    assert asked == [C.WORDS] and C.WORDS <= 300_000
    # How many words are kept changes no id and no place.
    assert sorted(packed) == sorted(pack_documents(docs, path, end_id=1, words=1).collect())


def test_a_word_table_starts_afresh_above_its_limit():
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    before = encode_texts(encoder, ["one two three four"])[0].tolist()
    encoder.make_room(10)
    assert len(encoder.index) == 4
    encoder.make_room(3)
    assert len(encoder.index) == 0 and encode_texts(encoder, ["one two three four"])[0].tolist() == before
