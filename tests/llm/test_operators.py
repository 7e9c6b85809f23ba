"""The operators against brute force on small tables with nulls, empty and repeated rows, ties and extra columns."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalcube.llm import (chat_windows, hnsw, language_id, mixing, ngram_join, packing, pu_quality, quality_rules, suffix_dedup, warc)
from evalcube.llm.common import read_documents, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, uid string, h int"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = _words(rng, 160)
    base = _words(rng, 300)
    near = base.split()
    near[7] = "changed"
    out = [(1, None, None, None), (2, "", "en", "b"), (3, " \n\t", "en", None), (4, "one", "en", "a"), (5, "One", "de", "a"),
           (6, base, "en", "a"), (7, base, "en", "a"), (7, base, "en", "a"), (8, " ".join(near), "en", "b"), (None, base, "de", None),
           (9, _words(rng, 50) + "\n" + passage + "\n" + _words(rng, 50), "de", "c"), (10, passage + " " + passage, "en", "c"),
           (11, "x" * 3000, "en", "c"), (12, "spam " * 400, "en", "c"), (13, _words(rng, 9000), "de", "a")]
    out += [(20 + i, _words(rng, rng.randrange(3, 200)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", None])) for i in range(40)]
    return [(*r, "clash", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stage(spark.createDataFrame(rows, SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return stage(spark.createDataFrame([], SCHEMA), "test-empty")


def _expected_spans(texts, n=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    for b in raw:
        cov = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                cov[i:i + n] = True
        left = bytes(c for c, x in zip(b, cov) if not x)
        yield len(b), int(cov.sum()), int((np.diff(np.concatenate([[0], cov.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()


def test_suffix_dedup(docs, rows):
    got = suffix_dedup.remove_repeats(docs).collect()
    want = Counter((r[0], *e) for r, e in zip(rows, _expected_spans([r[1] for r in rows])))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def _set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def test_ngram_join(docs, rows):
    sets = [_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                up[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    want = Counter((r[0], len(s), min((x for x in low[find(i)] if x is not None), default=None)) for i, (r, s) in enumerate(zip(rows, sets)))
    got = ngram_join.near_duplicate_groups(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r["first"] for r in got) == len(low)


def test_quality_rules(docs, rows):
    got = defaultdict(list)
    for r in quality_rules.judge(docs).collect():
        got[r.doc_id].append(r)
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        twice = {k for k, n in Counter(grams).items() if n > 1}
        cov = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[r[0]][0]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov))
        assert g.base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w))
        assert not (g.kept and g.base_failed)


def test_quality_rules_keep_clean_texts_of_small_languages(spark):
    rng = random.Random(6)
    prose = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."
    greek, russian = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыьэюя"
    en = [prose("abcdefghijklmnoprstuvwy", 4000) for _ in range(100)]
    texts = [(t, "en") for t in en] + [(prose(greek, 40), "el")] * 2 + [(prose(russian, 60), None)] + [(prose(russian, 300), "ru") for _ in range(4)]
    texts += [("$ # % & | " * 8 + prose("0123456789", 60), "ru"), (prose("0123456789", 60), "en"), (prose(greek, 4), "el")]
    df = stage(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id int, text string, lang string"), "test-langs")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert [got[i].kept for i in range(100, 110)] == [True] * 7 + [False] * 3
    assert got[100].js_chars is None and got[102].js_words is None and got[103].js_chars < 0.1 and got[107].js_chars > 0.27
    assert all(got[i].kept for i in range(100))


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    texts = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        texts[r.doc_id].append(np.frombuffer(r.ids, "<u4").tolist())
    for r in rows:
        if r[0] != 7:
            assert sum(texts[r[0]], []) == tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1


def test_packing_plan_holds_any_histogram():
    rng = np.random.default_rng(1)
    for scale in (0, 1, 40, 10**9):
        hist = (rng.random(4097) ** 6 * scale).astype(np.int64)
        hist[0] = 0
        held = np.zeros(4097, np.int64)
        for g, many in packing.plan(hist, 4096):
            assert sum(g) <= 4096
            for n in g:
                held[n] += many
        assert (held == hist).all()


def test_mixing(docs, rows):
    table, slices = mixing.mix(docs, block=16)
    taken = {r.uid: r.n for r in slices.groupBy("uid").agg(F.sum("n_words").alias("n")).collect()}
    size, per, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    for r in table.collect():
        assert r.source_size == size[r.source] and taken.get(r.uid, 0) <= 3 * r["size"]
        per[r.source] += taken.get(r.uid, 0)
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(per[s] - target[s]) <= 16 for s in target)
    n = sum(len(WORD.findall(r.text or "")) for r in mixing.mixed_documents(docs, slices).collect())
    assert n == sum(taken.values())
    assert {r.uid: r.n for r in mixing.mix(docs, block=16)[1].groupBy("uid").agg(F.sum("n_words").alias("n")).collect()} == taken


def test_permutation():
    for n in (1, 2, 3, 10, 257):
        assert sorted(mixing.permute(np.arange(n), n, 9).tolist()) == list(range(n))


def test_language_calibration_draws_rows_not_texts(spark):
    rows = spark.range(8_000).select(F.col("id").alias("uid"), F.when(F.col("id") % 2 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    got = Counter(r.text == "copy" for r in language_id._drawn(rows, 8_000, 1_000).collect())
    assert 420 < got[True] < 580 and 420 < got[False] < 580
    assert language_id._drawn(rows, 8_000, 9_000).count() == 8_000 and language_id._drawn(rows.limit(0), 0, 10).count() == 0


def test_warc(spark):
    html = [None, "", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "é" * 500]
    pages = [(i, ["http://www.b.org/x?b=1&a=2", None, "https://a.org/ y\n"][i % 3], html[i % 4], "extra") for i in range(40)]
    df = stage(spark.createDataFrame([*pages, (None, "u", "", None)], "page_id bigint, url string, html string, uid string"), "test-pages")
    got = warc.archive_and_index(df).orderBy("place").collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for p in pages:
        top[digest(p[2])] = max(top.get(digest(p[2]), -1), p[0])
    want = Counter()
    for p in [*pages, (None, "u", "", None)]:
        t = top[digest(p[2])]
        want[(p[0], len((p[2] or "").encode()), digest(p[2]), *(("response", None) if p[0] == t else ("revisit", t)))] += 1
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert [(r.urlkey, r.time) for r in got] == sorted((r.urlkey, r.time) for r in got)


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.choices(range(9), k=rng.randrange(7))) for _ in range(k)]
        assert [runs[r][i] for r, i in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_loser_tree_takes_runs_on_the_way():
    rng = random.Random(3)
    for k in (0, 1, 5, 40):
        blocks = sorted(b for b in (sorted(rng.choices(range(50), k=rng.randrange(1, 9))) for _ in range(k)))
        assert [b[i] for b, i in warc._merged((b, b) for b in blocks)] == sorted(x for b in blocks for x in b)


def test_warc_captures_are_fetched_by_their_place(spark, tmp_path):
    rng = random.Random(8)
    big = "".join(rng.choices("abcdefgh", k=1 << 20)) * 34
    html = {i: "".join(rng.choices("xyé\r\n", k=rng.randrange(6_000))) for i in range(300)} | {7: None, 8: "", 9: big, 10: big, 11: "same", 12: "same"}
    df = stage(spark.createDataFrame([(i, f"http://h{i % 4}.org/{i % 9}", h, "clash", 1) for i, h in html.items()],
                                     "page_id bigint, url string, html string, payload string, record string").repartition(3), "test-captures")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path, file_bytes=20_000)
    index = warc.read_index(spark, path, task_rows=40)
    rows = index.orderBy("place").collect()
    assert len({r.run for r in rows}) > 10 and len({r.place >> 33 for r in rows}) > 3
    assert [(r.urlkey, r.time, r.id, r.uid) for r in rows] == sorted((r.urlkey, r.time, r.id, r.uid) for r in rows)
    got = {r.id: r for r in warc.read_captures(index, path).collect()}
    assert set(got) == set(html)
    for i, h in html.items():
        again = {9: 10, 11: 12, 7: 8}.get(i)
        assert got[i].refers_to == again and got[i].payload_bytes == len((h or "").encode())
        assert got[i].payload == (None if again else (h or "").encode())
    whole = {}  # any gzip reader inflates a file's members one after the other, and one record's bytes alone
    for r in rows:
        if r.run not in whole:
            with open(r.run.removeprefix("file:"), "rb") as f:
                whole[r.run] = f.read()
        alone = gzip.decompress(whole[r.run][r.offset:r.offset + r.length])
        assert alone.startswith(b"WARC/1.1\r\n") and alone.endswith(b"\r\n\r\n")
    for raw in whole.values():
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == sum(r.run in whole and whole[r.run] is raw for r in rows)


def test_warc_reads_several_records_of_a_member():
    answer = b"HTTP/1.1 200 OK\r\nContent-Length: 6\r\n\r\nbody!!"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(answer) + answer + b"\r\n\r\n"
    one = gzip.compress(record)
    assert [(p, at, n) for _, p, at, n in warc.read_records(one + one)] == [(b"body!!", 0, len(one)), (b"body!!", len(one), len(one))]
    assert [(p, at) for _, p, at, _ in warc.read_records(gzip.compress(record + record))] == [(b"body!!", None)] * 2
    with pytest.raises(ValueError):
        list(warc.read_records(one[:-3]))


def test_chat_windows(spark):
    rng = random.Random(4)
    chats = [(c, None if c == 3 and t == 5 else t, rng.choice(["user", "assistant", "system", None]),
              rng.choice([None, "", "\\### a: </turn>\n", "word " * rng.randrange(600), "\\h\\\\l<#"])) for c in (1, 2, 3, None) for t in range(30)]
    chats += [chats[3], (9, 0, "system", "s" * 9000), (9, 1, "assistant", "a:b")]
    df = stage(spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string"), "test-chats")
    got = chat_windows.read_back(stage(chat_windows.windows(df), "test-windows")).collect()
    by = defaultdict(list)
    for c, t, r, x in chats:
        by[c].append((t is None, t or 0, r or "", x or ""))
    assert {r.conv for r in got} == set(by)
    for r in got:
        turns = sorted(by[r.conv])
        assert (r.n_turns, r.turns) == (len(turns), "".join(f"{a}\n{b}\n" for _, _, a, b in turns))
        assert r.loss == "".join(b for _, _, a, b in turns if a == "assistant")


def test_vector_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    vecs = [v for b in base for v in b + rng.normal(size=(6, 8)) * rng.choice([0.02, 0.4])]
    vecs = [v.astype(np.float32).tolist() for v in vecs] + [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [1.0, 2.0]]
    vecs += [vecs[0]] * 5
    df = stage(spark.createDataFrame(list(enumerate(vecs)), "vec_id bigint, embedding array<float>"), "test-vecs")
    good = {i: np.array(v, float) for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    link = defaultdict(set)
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                link[i].add(j)
    for r in hnsw.vector_groups(df).collect():
        seen, todo = {r.vec_id}, [r.vec_id]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        assert (r.n_links, r.component_id, r.kept) == (len(link[r.vec_id]), min(seen), r.vec_id == min(seen))


def test_language_id_held_out(spark, sf_dir):
    docs = read_documents(spark, "/root/testdata/sf0.01").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = language_id.identify(docs, ~F.col("held")).join(docs.select("doc_id", "lang", "held"), "doc_id").filter("held").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    odd = stage(spark.createDataFrame([(1, None, "en"), (2, "12 !?", "en"), (3, "the and of", None)], "doc_id int, text string, lang string"), "test-odd")
    assert {r.lang_pred for r in language_id.identify(odd, F.lit(False)).collect()} == {"und"}


def test_language_limits_come_from_all_learning_texts(spark):
    # 25 texts of a rare language: a sample of 2,000 of these rows holds about 12 of them, too few for a limit
    rows = [(i, "r" if i % 161 == 0 else "c", "xyz zyx yzx" if i % 161 == 0 else "abc cab bca") for i in range(4_025)]
    df = spark.createDataFrame([(-1, None, "xqxqx zwzwz yvyvy"), (-2, None, "xyz zyx yzx")] + rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in language_id.identify(df, F.lit(True)).filter("doc_id < 0").collect()}
    assert got[-1].lang_pred == got[-2].lang_pred == "r" and got[-1].rejected and not got[-2].rejected


def test_language_id_learns_rare_languages_whatever_the_shards(spark):
    rng = random.Random(8)
    names = ["aa", "bb", "rare", "tiny"]
    vocab = {x: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(300)]
             for x, letters in zip(names, ("abcdefghij", "defghijklm", "αβγδεζηθικ", "fghijklmno"))}
    prose = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    rows = [(prose(x, 2000), x, False) for x in ("aa", "bb") for _ in range(60)] + [(prose("rare", 240), "rare", False), (prose("tiny", 8), "tiny", False)]
    rows += [(prose(x, 30), x, True) for x in names[:3] for _ in range(10)] + [("δδδ ζζη", "rare", True), (None, "aa", True)]
    df = stage(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, text string, lang string, held boolean"), "test-rare")
    one, many = ({r.doc_id: (r.lang_pred, r.cross_entropy) for r in language_id.identify(df, ~F.col("held"), shard_rows=n).collect()}
                 for n in (4_000_000, 3_000))
    for i, r in enumerate(rows):
        assert one[i][0] == many[i][0] == (r[1] if r[0] else "und")
        assert one[i][1] is None or one[i][1] == pytest.approx(many[i][1])


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_documents(spark, sf), read_documents(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = pu_quality.score_quality(docs, labels, ~held).join(labels, "doc_id").filter(held).collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    nothing = pu_quality.score_quality(docs.limit(5), labels.filter("false"), ~held).collect()
    assert [r.score for r in nothing] == [0.5] * 5


def test_quality_calibration_does_not_depend_on_the_sample_bound(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_documents(spark, sf).select("doc_id", "text"), read_documents(spark, sf, "labels")
    twice = stage(docs.union(docs), "test-twice")
    whole, cut, doubled = ({r.doc_id: r.score for r in pu_quality.score_quality(d, labels, F.lit(True), max_positive=most).collect()}
                           for d, most in ((docs, 12_000), (docs, 600), (twice, 600)))
    share = np.mean([r.quality for r in labels.collect()])
    known = [r.doc_id for r in labels.collect()]
    for got in (whole, cut, doubled):
        assert abs(np.mean([got[i] for i in known]) - share) < 0.06
        assert np.mean([(got[i] >= 0.7) == (whole[i] >= 0.7) for i in whole]) > 0.93
    x = np.zeros((90, pu_quality.N_FEATURES))
    x[:, 0] = np.random.default_rng(1).normal(size=90)
    scorer = pu_quality.Scorer(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.eye(x.shape[1])[0], 0.0)
    pu_quality.platt(scorer, np.concatenate([x[:60]] * 6 + [x[60:]]), np.repeat([1, 0], [360, 30]), 360, 30)
    full = (scorer.a, scorer.b)
    pu_quality.platt(scorer, x, np.repeat([1, 0], [60, 30]), 360, 30)
    assert (scorer.a, scorer.b) == pytest.approx(full)


def test_chosen_rows_grow_evenly(spark):
    many = [pu_quality._chosen(spark.range(n).withColumnRenamed("id", "uid"), n, 1000).count() for n in (900, 1000, 1001, 1100, 1900, 2500)]
    assert many[:2] == [900, 1000] and all(850 < k < 1150 for k in many[2:])


def test_empty_tables(spark, empty):
    import public_tokenizers
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert ngram_join.near_duplicate_groups(empty).count() == 0
    assert quality_rules.judge(empty).count() == 0
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    table, slices = mixing.mix(empty)
    assert table.count() == slices.count() == 0
    assert language_id.identify(empty, F.lit(True)).count() == 0
    none = lambda ddl: stage(spark.createDataFrame([], ddl), "test-none")
    assert warc.archive_and_index(none("page_id bigint, url string, html string")).count() == 0
    assert chat_windows.read_back(stage(chat_windows.windows(none("conv_id bigint, turn bigint, role string, text string")), "w")).count() == 0
    assert hnsw.vector_groups(none("vec_id bigint, embedding array<float>")).count() == 0
    assert pu_quality.score_quality(empty, none("doc_id bigint, quality int"), F.lit(True)).count() == 0


def test_chat_ids_of_text_are_told_from_null(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), ("null", 0, "user", "c"), ("null", 1, "assistant", "d")]
    chats = stage(spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string"), "test-null-ids")
    back = chat_windows.read_back(stage(chat_windows.windows(chats), "test-null-windows")).collect()
    assert sorted((r.conv or "", r.n_turns, r.loss) for r in back) == [("", 2, "b"), ("null", 2, "d")]
