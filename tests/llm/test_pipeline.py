"""The pipeline: each stage against plain Python on what the one before kept."""

import hashlib
from collections import Counter

import pytest
from cases import docs
from test_jaccard import brute, families
from test_simple_operators import WORD, mix_targets

import corpus_pipeline
from tessera.llm import langid, secrets

ENGLISH = "the cat and the dog went over the hill to see what they would find there in"
FRENCH = "le chat et le chien sont partis sur la colline pour voir ce qu'ils y trouveraient"


def made():
    out = []
    for k, (i, text, *_) in enumerate(families(5, 10)):
        lead = ENGLISH if k % 3 else FRENCH
        out.append((i, f"{lead} {text}" + (" password=Xk29fj3k2" if k % 4 == 0 else ""), "en" if k % 3 else "fr", f"s{k % 4}" if k % 5 else None, 9, "x", 1))
    more = [(900, None, "en", "s1", None, None, None), (901, "", None, None, 0, None, None), (902, "12345 !!! 6789", "en", "s1", 14, None, None), (None, ENGLISH, "en", "s2", 5, None, None), (None, ENGLISH, "en", "s2", 5, None, None)]
    return out + more


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["language_id", "near_duplicates", "secret_scan", "mixture", "tokens"]
    start = docs(spark, made())
    # language: what is und goes, and what has no language with half of the words
    kept = stages["language_id"](spark, start, "")
    assert kept.schema == start.schema
    judged = langid.identify(start, langid.train(start.where(~langid.held_out(start.doc_id)))).collect()
    rows = [tuple(r) for r in kept.collect()]
    assert Counter(r[0] for r in rows) == Counter(r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.5)
    assert not {900, 901, 902} & {r[0] for r in rows} and len(rows) > len(made()) * 0.8
    # near-duplicates: one of each group
    left = [tuple(r) for r in stages["near_duplicates"](spark, docs(spark, rows), "").collect()]
    parts = brute(rows, 5, 80)
    assert sorted({r[0] for r in left if r[0] is not None}) == sorted({i for i, _, c in parts if i is not None and i == c})
    assert len({r[0] for r in left if r[0] is not None}) == len([r for r in left if r[0] is not None]) and sum(r[0] is None for r in left) == 2
    assert set(left) <= set(rows)
    # secrets are redacted, nothing else changes
    clean = [tuple(r) for r in stages["secret_scan"](spark, docs(spark, left), "").collect()]
    scanner = secrets.Scanner()
    assert sorted(clean, key=key) == sorted(((r[0], t := scanner.redact(r[1]), *r[2:4], len(t), *r[5:]) for r in left), key=key)
    assert not any("Xk29fj3k2" in r[1] for r in clean) and any("[secret]" in r[1] for r in clean)
    # mixture: whole copies, near the targets
    mixed = [tuple(r) for r in stages["mixture"](spark, docs(spark, clean), "").collect()]
    size = Counter()
    for r in clean:
        size[r[3]] += len(WORD.findall(r[1]))
    goal = mix_targets(size)
    taken, times = Counter(), Counter(mixed)
    for r in mixed:
        taken[r[3]] += len(WORD.findall(r[1]))
    for r, n in Counter(clean).items():
        rate = goal[r[3]] / size[r[3]]
        assert int(rate) * n <= times[r] <= (int(rate) + 1) * n
    assert set(mixed) <= set(clean)
    # tokens
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    out = stages["tokens"](spark, docs(spark, mixed), "").collect()
    want = [(r[0], len(library.encode(r[1]).ids), hashlib.sha256(r[1].encode()).hexdigest()) for r in mixed]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out), key=key) == sorted(want, key=key)


def test_run_is_the_stages(spark, tmp_path):
    docs(spark, made()).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        step = spark.read.parquet(str(tmp_path / str(k)))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, step.collect()), key=key)


def test_empty(spark):
    step = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "")
    assert step.count() == 0
