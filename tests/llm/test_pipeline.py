"""Stages of the pipeline on planted texts."""

import random

import corpus_pipeline
from evalcube.llm.common import stage

SCHEMA = "doc_id bigint, text string, lang string, source string"


def _words(rng, n, letters=8):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(letters)) for _ in range(n)]


def _docs(spark, texts, name):
    return stage(spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], SCHEMA).repartition(3), name)


def _without_repeats(texts, words=51, size=400):
    """Texts without the bytes of runs of ``words`` words and of ``size`` bytes that occur twice or more."""
    raw = [(t or "").encode() for t in texts]
    word, byte, places = {}, {}, []
    for d, b in enumerate(raw):
        w, at = [], 0
        for x in b.split():
            at = b.index(x, at)
            w.append((x, at, at + len(x)))
            at += len(x)
        places.append(w)
        for i in range(len(w) - words + 1):
            word.setdefault(tuple(x for x, _, _ in w[i:i + words]), []).append((d, w[i][1], w[i + words - 1][2]))
        for i in range(len(b) - size + 1):
            byte.setdefault(b[i:i + size], []).append((d, i, i + size))
    gone = [set() for _ in raw]
    for hits in (*word.values(), *byte.values()):
        for d, a, z in hits if len(hits) > 1 else ():
            gone[d].update(range(a, z))
    return [bytes(c for i, c in enumerate(b) if i not in gone[d]).decode("utf-8", "ignore") for d, b in enumerate(raw)]


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(3)
    short, fifty, long = _words(rng, 51, 3), _words(rng, 50, 3), _words(rng, 60, 9)
    other = _words(rng, 70, 2)
    texts = [" ".join([*_words(rng, 40), *p, *_words(rng, 40)]) for p in (short, short, fifty, fifty, long, long, [])]
    texts += [" ".join(other + _words(rng, 9)), "  ".join(_words(rng, 9) + other) + "\n", "x" * 500 + " end", "y " + "x" * 500, None, "", "one"]
    texts += [" ".join(short + _words(rng, 3) + short + long[:55]), "spam " * 200 + " ".join(_words(rng, 5))]
    got = {r.doc_id: r.text for r in corpus_pipeline.passage_stage(spark, _docs(spark, texts, "test-passages"), "").collect()}
    want = _without_repeats(texts)
    assert " ".join(short) not in " ".join(want) and " ".join(fifty) in want[2]
    for i, t in enumerate(texts):
        if want[i].split() or want[i] == (t or ""):
            assert (got[i] or "") == want[i]
        else:
            assert i not in got


def test_near_duplicates_from_80_percent_of_five_words_are_one(spark):
    # a changed word in the middle of n distinct ones leaves n - 9 of n + 1 five-word shingles in common
    rng = random.Random(4)
    texts, expected = [], []
    for n in (47, 48, 49, 50, 120):
        a = _words(rng, n)
        texts += [" ".join(a), " ".join([*a[:20], "changed", *a[21:]])]
        expected += [True, 100 * (n - 9) < 80 * (n + 1)]
    texts += [None, "", texts[0].upper(), texts[0] + " end", "one", "one"]
    expected += [True, True, False, False, True, False]
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, _docs(spark, texts, "test-near"), "").collect()}
    assert got == {i for i, kept in enumerate(expected) if kept}


CLASH = SCHEMA + ", uid string, pass string, raw string, parts string, _kept string, first string, n_words string, _further_0 string"


def test_further_columns_keep_their_names_and_values(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(_words(rng, 60)), "en", "ab"[i % 2], *(f"{c}{i}" for c in range(8))) for i in range(20)]
    docs = stage(spark.createDataFrame(rows, CLASH), "test-clash")
    for name, step in corpus_pipeline.STAGES[:4]:
        docs = stage(step(spark, docs, ""), "test-clash-out")
        assert docs.columns == [c.split()[0] for c in CLASH.split(", ")], name
        assert {tuple(r)[4:] for r in docs.collect()} <= {r[4:] for r in rows} and docs.count() >= 20, name


def test_run_over_planted_texts_and_an_empty_table(spark, tmp_path):
    rng = random.Random(7)
    shared = _words(rng, 55)
    base = _words(rng, 150)
    texts = [" ".join(_words(rng, 80)) for _ in range(12)]
    texts += [" ".join(base), " ".join(base), " ".join([*base[:70], "other", *base[71:]])]  # copies: the first stays
    texts += [" ".join(_words(rng, 60) + shared), " ".join(shared + _words(rng, 70))]  # a passage in two documents
    texts += [None, "", "too few words", "spam " * 300]  # rejected
    (tmp_path / "in").mkdir()
    _docs(spark, texts, "test-run").coalesce(2).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()
    assert {r.doc_id for r in out} == {*range(13), 15, 16}
    from tokenizers import Tokenizer

    from evalcube.llm.queries_llm import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path())
    alone = _without_repeats([texts[15], texts[16]])
    whole = {i: texts[i] for i in range(13)} | {15: alone[0], 16: alone[1]}
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in whole.items()}
    for r in out:  # a pass of the mix is a document or its beginning
        assert r.length <= 4096 and r.length <= len(ids[r.doc_id]) + 1
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096
    (tmp_path / "none").mkdir()
    _docs(spark, [], "test-none").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
