"""Character and word distances of the quality rules against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
import regex

from evalcube.llm import quality_rules
from evalcube.llm.common import stage

SETS = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]", r"[\p{L}--[a-zA-Z]]"]


def _classes(text):
    some = [len(regex.findall(s, text, flags=regex.V1)) for s in SETS]
    return [*some, len(text) - sum(some)]


def _js(p, q):
    tp, tq = sum(p), sum(q)
    if not tp or not tq:
        return 0.0 if tp == tq else 1.0
    out = 0.0
    for a, b in zip(p, q):
        a, b = a / tp, b / tq
        out += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x) / 2
    return math.sqrt(max(out, 0.0))


@pytest.mark.parametrize("min_ref", [10, 400])
def test_distances_equal_brute_force(spark, min_ref):
    rng = random.Random(8)
    vocab = {"en": ["the", "of", "and", "Word", "longish", "x1", "fine."], "el": ["και", "το", "λέξη", "είναι", "ένα"], "xx": ["zz", "#", "%%"]}
    rows = [(1, None, "en", "c"), (2, "", "el", "c"), (3, "THE the", None, "c")]
    for i in range(90):
        lang = rng.choice(["en", "en", "el", "el", "xx", None])
        words = [rng.choice(vocab[lang or "en"]) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(rng.randrange(5, 60 if lang != "xx" else 14))]
        rows.append((10 + i, rng.choice([" ", "\n"]).join(words), lang, "c"))
    rows.append(rows[5])
    docs = stage(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, js_words string"), "test-js")
    got = sorted((r for r in quality_rules.judge(docs, min_ref_words=min_ref).collect()), key=lambda r: r.doc_id)
    sound, words = defaultdict(list), {}
    failed = {r.doc_id: r.base_failed for r in got}
    for d, text, lang, _ in rows:
        words[d] = [w for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if w]
        if not failed[d] and lang is not None:
            sound[lang].append((d, text))
    refs = {}
    for lang, texts in sound.items():
        n = sum(len(words[d]) for d, _ in texts)
        if n >= min_ref:
            short = Counter(w.lower() for d, _ in texts for w in words[d] if len(w) <= 5 and regex.fullmatch(r"\p{L}+", w))
            top = sorted(short.items(), key=lambda x: (-x[1], x[0].encode()))[:16]
            refs[lang] = ([w for w, _ in top], [c for _, c in top] + [n - sum(c for _, c in top)],
                          [sum(x) for x in zip(*(_classes(t) for _, t in texts))])
    by = {d: (text, lang) for d, text, lang, _ in rows}
    assert {lang for _, lang in by.values()} - set(refs) >= {None}
    for r in got:
        text, lang = by[r.doc_id]
        if lang not in refs:
            assert r.js_words is None and r.js_chars is None and r.kept == (not r.base_failed)
            continue
        common, q_words, q_chars = refs[lang]
        count = Counter(w.lower() for w in words[r.doc_id] if len(w) <= 5 and regex.fullmatch(r"\p{L}+", w))
        p = [count[w] for w in common]
        assert r.js_words == pytest.approx(_js([*p, len(words[r.doc_id]) - sum(p)], q_words), abs=1e-9)
        assert r.js_chars == pytest.approx(_js(_classes(text or ""), q_chars), abs=1e-9)
        odd = r.n_words >= 30 and (r.js_chars > 0.27 or r.js_words > 0.45)
        assert r.kept == (not r.base_failed and not odd)
