import random

import numpy as np
import public_tokenizers
import sentencepiece

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "a\n b", "▁", "▁▁a", "a▁b", "é ﬁ \x00z", "<s> </s> <unk>", "日本語 テキスト", "🙂🙂 x", "aaaa" * 500, "\t\ttab", "x y　z", "- - -"]


def test_chunks_give_what_the_library_gives():
    whole = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    alphabet = ["a", "th", "ing", " ", "  ", "\n", "▁", "é", "ß", "1", ".", "日", "\x00", "<", "🙂"]
    batch = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    table = pieces.ChunkTable(PATH, most=200)
    for start in range(0, len(batch), 97):
        part = batch[start : start + 97]
        offsets, ids = table.encode(part)
        for text, a, b in zip(part, offsets[:-1], offsets[1:], strict=True):
            assert ids[a:b].tolist() == whole.encode(text, add_eos=True), text


def test_round_trip(spark):
    whole = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(99, None)], "doc_id long, text string")
    made = {r["doc_id"]: r for r in pieces.encode(docs, PATH).collect()}
    assert made[99]["ids"] == [2] and made[99]["decoded"] == ""
    for i, text in enumerate(HARD):
        assert made[i]["decoded"] == whole.decode(whole.encode(text, add_eos=True))
    digest = pieces.digests(pieces.encode(docs.where("doc_id = 99"), PATH)).first()
    assert digest["n_tokens"] == 1 and digest["ids_sha256"].startswith("d4735e3a265e16ee")


def test_markers_are_checked():
    assert pieces.cuts_at_markers(sentencepiece.SentencePieceProcessor(model_file=PATH))


def test_empty_batch():
    offsets, ids = pieces.ChunkTable(PATH).encode([])
    assert offsets.tolist() == [0] and ids.dtype == np.int32 and len(ids) == 0
