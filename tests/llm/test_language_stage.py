"""What the language stage lets through, and what it keeps from the stages that follow."""

import numpy as np
import pyarrow as pa
import pytest
from cases import docs

import corpus_pipeline
from tessera.llm import langid

ENGLISH = "the cat and the dog went over the hill to see what they would find there"
FRENCH = "le chat et le chien sont partis sur la colline pour voir ce qu'ils y trouveraient"
TRAIN = [(100 + k, (ENGLISH, FRENCH)[k % 2], ("en", "fr")[k % 2], "s", 0, None, None) for k in range(12)]
STAY = {
    1: ENGLISH,
    2: f"{ENGLISH} {FRENCH}",
    3: "the | cat | and | dog | == | went",  # signs are no words
    4: "the cat 4532 7781",  # half of the words
    5: "xq7zz " * 3 + ENGLISH,
    6: "The&&& cat### and%%% dog*** went.",
}
GO = {
    11: "Это предложение написано по-русски, и никто его не учил",
    12: "日本語の文章です 東京 都",
    13: "xqz zzkw qjx vvbq kkzz wxqj pqzx jjvw",
    14: "the cat 4532 7781 9902",
    15: f"{'zxqj vvkq ' * 20}{ENGLISH}",
}


def test_stage_drops_what_no_language_explains(spark):
    odd = [(i, t, None, "s", 0, None, None) for i, t in (STAY | GO).items()]
    kept = corpus_pipeline.language_id(spark, docs(spark, TRAIN + odd), "")
    assert {r.doc_id for r in kept.collect() if r.doc_id < 100} == set(STAY)
    # one row or many in a batch, in any order: the same rows go
    model = langid.train(docs(spark, TRAIN))
    for some in (odd[::-1], [odd[8]], odd[6:9] * 3):
        assert sorted(r.doc_id for r in langid.keep(docs(spark, some), model).collect()) == sorted(r[0] for r in some if r[0] in STAY)


def test_share_is_that_of_single_words(spark):
    """Each word by itself against the languages of the text's set."""
    model = langid.train(docs(spark, TRAIN))
    texts = [*STAY.values(), *GO.values(), None, "", " \t", "a1 b2", "x" * 3000, "1234 !!!", "=" * 20 + " the"]
    pred, _, sets, share = langid._judged(model, pa.array(texts, pa.string()), explain=True)
    for text, p, chosen, got in zip(texts, pred, sets, share, strict=True):
        words = [w for w in (text or "").encode().split() if any(c > 127 or chr(c).isalnum() for c in w)]
        known = 0
        for w in words:
            data = np.frombuffer(w, np.uint8)
            code, inside, _ = langid.trigram_codes(data, np.array([0, len(data)]))
            gain = (model.log[code[inside]].astype(float) + np.log(langid.CODES)).sum(axis=0)
            known += bool(inside.any()) and any(gain[model.langs.index(x.split(":")[0])] > 0 for x in chosen.split(",") if x)
        assert p == "und" or got == pytest.approx(known / len(words)), text
