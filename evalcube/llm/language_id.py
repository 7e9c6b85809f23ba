"""Language identification by interpolated Kneser-Ney character models, one for each language.

Learning counts the 4-grams of letters (lower case; runs of anything else are one
space) of every learning text on the cluster, in every language, however rare.
Lower orders use Kneser-Ney continuation counts. Counts, discounts, log
probabilities and back-off weights are worked out in Spark over all grams; what a
language has never seen shares one alphabet, that of all languages. The model
grows with the grams: it is scored in shards of about ``shard_rows`` rows by hash
of a gram's two middle characters, so a shard holds all that its grams back off
to (orders 1 and 2 are in each). A worker holds one shard at a time.

A text gets the language of the lowest cross-entropy for each character. The
score is the posterior of that language at a temperature fitted on all learning
texts; the same texts give each language the cross-entropy above which
``rejected`` is true. Both come from sums of whole numbers, so reruns agree.

Defined cases: null text and text without a letter is ``und`` with score 0, and
so is all text if nothing was learned; ties go to the first language by code
point; a null language teaches nothing; repeated rows count twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import mix
from .common import stage, with_uid

U = np.uint64
ORDER = 4
#: Below 2**31, so a product with two characters of 16 bits stays below 2**63, in SQL as well.
_PAIR = 1640531527
_HASHES = 1 << 30
UNKNOWN = "und"
_SPACE = 0x20
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code of each of the first 65,536 code points: its lower-case letter, or a space."""
    if not _table:
        t = np.full(1 << 16, _SPACE, np.uint64)
        for c in range(1 << 16):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                t[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
        _table.append(t)
    return _table[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram ending at each character, its text, letters of each text)."""
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _letters()[np.minimum(cp, 0xFFFF)]
    for i in np.flatnonzero(cp >= 1 << 16).tolist():  # letters beyond the table share one code
        code[i] = 0xFFFF if chr(cp[i]).isalpha() else _SPACE
    size = np.array([len(t) + 1 for t in texts], np.int64)
    size[-1] -= 1
    doc = np.repeat(np.arange(len(texts)), size)
    space = code == _SPACE
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1]) | (doc[1:] != doc[:-1])
    code, doc, space = code[keep], doc[keep], space[keep]
    first = np.searchsorted(doc, np.arange(len(texts)))
    place = np.arange(len(code)) - first[doc] if len(code) else doc
    key = code.copy()
    for k in range(1, ORDER):
        before = np.full(len(code), _SPACE, np.uint64)
        before[k:] = code[:-k] if k else code
        key |= np.where(place >= k, before, U(_SPACE)) << U(16 * k)
    return key, doc, np.bincount(doc[~space], minlength=len(texts))


def _chunks(texts: list[str | None], size: int = 1 << 21):
    first, part, total = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t or "")
        total += len(part[-1])
        if total >= size:
            yield first, part
            first, part, total = i + 1, [], 0
    if part:
        yield first, part


def _count(batches):
    """(text, lang) -> (lang, gram, n): counts of the task, given out when they have become many."""
    have: dict[str, list[pd.Series]] = {}

    def out():
        for lang, parts in have.items():
            s = pd.concat(parts).groupby(level=0).sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(s), pa.string()), pa.array(s.index.to_numpy(np.uint64).view(np.int64)), pa.array(s.to_numpy(np.int64))],
                names=["lang", "gram", "n"])
        have.clear()

    held = 0
    for b in batches:
        langs = np.array(b.column(1).to_pylist(), object)
        for lang in sorted(set(langs)):
            mine = np.flatnonzero(langs == lang)
            for _, part in _chunks([b.column(0)[int(i)].as_py() for i in mine]):
                code, distinct = pd.factorize(grams(part)[0])
                have.setdefault(lang, []).append(pd.Series(np.bincount(code, minlength=len(distinct)), index=distinct))
                held += len(distinct)
        if held > 2_000_000:
            merged = {lang: [pd.concat(p).groupby(level=0).sum()] for lang, p in have.items()}
            have.update(merged)
            held = sum(len(p[0]) for p in merged.values())
            if held > 1_000_000:
                yield from out()
                held = 0
    yield from out()


class Sorted:
    """Values by key in an array sorted by the keys' hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys.astype(np.uint64))
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order].astype(np.float64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        if not len(self.hashes):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        h = mix(keys)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[i] == h, self.values[i]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of 4-grams, by their two middle characters."""
    pair = (keys.astype(np.uint64) >> U(16)) & U(0xFFFFFFFF)
    return ((pair * U(_PAIR) >> U(20)) % U(shards)).astype(np.int64)


class KneserNey:
    """Interpolated model of one language: what a shard holds of it."""

    def __init__(self, rows: pd.DataFrame, floor: float):
        self.floor = floor
        self.levels: list[tuple[Sorted, Sorted]] = []  # from order 1 up: probabilities, back-off weights
        for order in range(1, ORDER + 1):
            self.levels.append(tuple(Sorted(x["key"].to_numpy(np.int64).view(np.uint64), x["value"].to_numpy())
                                     for x in (rows[(rows["level"] == order) & (rows["back"] == back)] for back in (False, True))))

    def _prob(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Probability of the last character of each key after the ``order`` - 1 before it."""
        if order == 0:
            return np.full(len(keys), self.floor)
        k = keys & U((1 << 16 * order) - 1)
        prob, back = self.levels[order - 1]
        seen, p = prob.get(k)
        out = np.where(seen, p, 0.0)
        rest = np.flatnonzero(~seen)
        if len(rest):
            known, w = back.get(k[rest] >> U(16))
            out[rest] = np.where(known, w, 1.0) * self._prob(k[rest], order - 1)
        return out

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        return np.log(self._prob(keys, ORDER))


def entropies(shards: list, n_langs: int, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cross-entropy of each text and language, characters, letters); ``shards`` are broadcast lists of models."""
    ces, chars, letters = [], [], []
    for _, part in _chunks(texts):
        key, doc, n_letters = grams(part)
        code, distinct = pd.factorize(key)
        n = np.bincount(doc, minlength=len(part))
        home = _shard(distinct, max(1, len(shards)))
        ce = np.zeros((len(part), n_langs))
        for s, sent in enumerate(shards):
            mine = np.flatnonzero(home == s)
            if not len(mine):
                continue
            models = sent.value
            some = home[code] == s if len(shards) > 1 else slice(None)
            of, at = doc[some], code[some]
            lp = np.zeros(len(distinct))
            for k, m in enumerate(models):
                lp[mine] = m.log_prob(distinct[mine])
                ce[:, k] -= np.bincount(of, weights=lp[at], minlength=len(part))
            if len(shards) > 1:
                del models
                sent.__dict__.pop("_value", None)  # the worker reads it again when it is needed
        ces.append(ce / np.maximum(n, 1)[:, None])
        chars.append(n)
        letters.append(n_letters)
    if not ces:
        return np.zeros((0, n_langs)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ces), np.concatenate(chars), np.concatenate(letters)


def posterior(ce: np.ndarray, chars: np.ndarray, heat: float) -> np.ndarray:
    z = -(ce - ce.min(1, keepdims=True)) * np.sqrt(chars)[:, None] * heat
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def _levels(counts: DataFrame) -> DataFrame:
    """(lang, level, back, key, value): probabilities and, where ``back``, the weights of what a context backs off to.

    ``counts`` are all 4-grams (lang, key, n) of the learning texts.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation: distinct grams that end alike
        tables[order] = stage(tables[order + 1].select("lang", F.col("key").bitwiseAND((1 << 16 * order) - 1).alias("key"))
                              .groupBy("lang", "key").agg(F.count("*").alias("n")), f"lid-n{order}")
    prob = tables[1].agg(F.count_distinct("key").alias("chars")).select((1 / (F.col("chars") + 1)).alias("value"))
    out = None
    for order in range(1, ORDER + 1):
        rows = tables[order]
        ones, twos = (F.count_if(F.col("n") == k) for k in (1, 2))
        d = rows.groupBy("lang").agg(F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
        ctx = (rows.groupBy("lang", F.shiftrightunsigned("key", 16).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("many"))
               .join(d, "lang").select("lang", "ctx", "total", "d", (F.col("d") * F.col("many") / F.col("total")).alias("weight")))
        ctx = stage(ctx, f"lid-c{order}")
        rows = rows.withColumn("ctx", F.shiftrightunsigned("key", 16)).join(ctx, ["lang", "ctx"])
        if order == 1:
            rows = rows.crossJoin(F.broadcast(prob.withColumnRenamed("value", "lower")))  # one number
        else:
            rows = rows.withColumn("low", F.col("key").bitwiseAND((1 << 16 * (order - 1)) - 1)).join(
                prob.select("lang", F.col("key").alias("low"), F.col("value").alias("lower")), ["lang", "low"])
        prob = stage(rows.select("lang", "key", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
                                                 + F.col("weight") * F.col("lower")).alias("value")), f"lid-p{order}")
        both = prob.select("lang", F.lit(order).alias("level"), F.lit(False).alias("back"), "key", "value").union(
            ctx.select("lang", F.lit(order), F.lit(True), "ctx", "weight"))
        out = both if out is None else out.union(both)
    return out


def _shards(counts: DataFrame, langs: list[str], shard_rows: int) -> list:
    """The model, a broadcast list of one KneserNey for each language for each shard."""
    spark = counts.sparkSession
    model = _levels(counts)
    order = spark.createDataFrame(list(enumerate(langs)), "k int, lang string")
    pair = F.when(F.col("back"), F.col("key")).otherwise(F.shiftrightunsigned("key", 16)).bitwiseAND(0xFFFFFFFF)
    n = max(1, -(-model.filter("level > 2").count() // shard_rows))
    at = F.when(F.col("level") > 2, F.shiftright(pair * F.lit(_PAIR), 20) % n).otherwise(F.lit(-1)).cast("int")
    table = stage(model.withColumn("shard", at).join(order, "lang").select("shard", "k", "level", "back", "key", "value"), "lid-model")
    floor = 1 / (table.filter("level = 1 AND NOT back").agg(F.count_distinct("key")).first()[0] + 1)
    out = []
    for s in range(n):
        rows = table.filter(F.col("shard").isin(-1, s)).drop("shard").toPandas()
        by = dict(tuple(rows.groupby("k")))
        out.append(spark.sparkContext.broadcast([KneserNey(by[k], floor) for k in range(len(langs))]))
        del rows, by
    return out


def _drawn(rows: DataFrame, n: int, about: int) -> DataFrame:
    """About ``about`` of ``n`` rows (all of fewer), by hash of the row number, so whatever their texts."""
    return rows.filter(F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(_HASHES)) < min(_HASHES, -(-_HASHES * about // max(1, n))))


_HEATS = (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4)
#: Fixed point of the calibration's sums: of losses, and of cross-entropies (a batch's squares fit 63 bits).
_LOSS, _CE = 1 << 30, 1 << 16


def _calibrated(rows: DataFrame, shards: list, langs: list[str]) -> tuple[float, list[float]]:
    """(heat, limits) from all ``rows`` (text, lang): summed in the tasks, a row for each heat and language comes back."""
    def score(batches):
        place = {x: k for k, x in enumerate(langs)}
        for b in batches:
            ce, chars, letters = entropies(shards, len(langs), b.column(0).to_pylist())
            true = np.array([place[x] for x in b.column(1).to_pylist()], np.int64)
            ce, chars, true = ce[letters > 0], chars[letters > 0], true[letters > 0]
            out = []
            for i, h in enumerate(_HEATS):
                loss = -np.log(np.maximum(posterior(ce, chars, h)[np.arange(len(true)), true], 1e-9))
                out.append((-1 - i, len(true), int(np.rint(loss * _LOSS).astype(np.int64).sum()), 0))
            for k in range(len(langs)):
                mine = np.rint(ce[(true == k) & (ce.argmin(1) == k), k] * _CE).astype(np.int64)
                out.append((k, len(mine), int(mine.sum()), int((mine * mine).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["k", "n", "s", "q"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = {r["k"]: (int(r["n"]), int(r["s"]), int(r["q"])) for r in rows.select("text", "lang").mapInArrow(
        score, "k bigint, n bigint, s bigint, q bigint").groupBy("k").agg(exact("n"), exact("s"), exact("q")).collect()}
    heat, limits = 1.0, [np.inf] * len(langs)
    if sums.get(-1, (0,))[0]:
        heat = min(enumerate(_HEATS), key=lambda x: sums[-1 - x[0]][1])[1]
    for k in range(len(langs)):
        n, s, q = sums.get(k, (0, 0, 0))
        if n >= 20:
            limits[k] = (s / n + 6 * (max(0, n * q - s * s) ** 0.5 / n)) / _CE + 1 / _CE
    return heat, limits


def train(rows: DataFrame, shard_rows: int, calibration: int | None = None):
    """(languages, shards of the model, heat, limits) from (uid, text, lang) rows without null languages.

    All of them calibrate; a number draws about so many by row number: copies of a text count like any rows.
    """
    counts = stage(rows.select("text", "lang").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", F.col("gram").alias("key"))
                   .agg(F.sum("n").alias("n")), "lid-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return [], [], 1.0, []
    shards = _shards(counts, langs, shard_rows)
    heat, limits = _calibrated(rows if calibration is None else _drawn(rows, rows.count(), calibration), shards, langs)
    return langs, shards, heat, limits


def identify(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             shard_rows: int = 4_000_000, calibration: int | None = None) -> DataFrame:
    """(uid, id, lang_pred, score, cross_entropy, rejected), one row for each row of ``docs``.

    ``learn`` says which rows may teach; of those the text and non-null language are used.
    """
    rows = with_uid(docs)
    teach = rows.filter(learn).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        "uid", F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, shards, heat, limits = train(teach, shard_rows, calibration)
    typ = dict(docs.dtypes)[id_col]

    def predict(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            ce, chars, letters = entropies(shards, len(langs), texts)
            none = np.array([t is None for t in texts], bool) | (letters == 0) | (not langs)
            if langs:
                best = ce.argmin(1)
                low = ce[np.arange(len(best)), best]
                score = posterior(ce, chars, heat)[np.arange(len(best)), best]
                over = low > np.array(limits)[best]
                name = np.array(langs, object)[best]
            else:
                low, score, over, name = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool), np.full(len(texts), UNKNOWN, object)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.where(none, UNKNOWN, name), pa.string()), pa.array(np.where(none, 0.0, score)),
                 pa.array(np.where(none, None, low).tolist(), pa.float64()), pa.array(none | over, pa.bool_())],
                names=["uid", "id", "lang_pred", "score", "cross_entropy", "rejected"])

    out = rows.select("uid", F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        predict, f"uid bigint, id {typ}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
