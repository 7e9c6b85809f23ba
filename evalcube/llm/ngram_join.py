"""Near-duplicate groups by an exact Jaccard join on word shingles.

Two texts link when 100 * |A n B| >= percent * |A u B| over their sets of
distinct shingles. Candidates must share prefix tokens under several global
token orders, so no link is lost:

1. Texts with the same set are one class (a count over set signatures); a class
   takes part once, however many copies it has.
2. Hash order: with k(a) = a - ceil(percent * a / 100) tokens that may be
   missing and l(a) = ceil(a / 10), the first k(a) + l(a) tokens of linked sets
   share at least l tokens (l of the smaller set).
3. Rarity order over those prefixes (tokens by the number of classes that have
   them, rarest first): with r(a) = l(ceil(percent * a / 100)) shared tokens, the
   rarest |prefix| - r + 1 of them hold a common one. Tokens of one class only
   come first and pair with nothing, so an unrelated text produces nothing and
   takes no further part.
4. Rarity order over the whole sets of the texts that are left: the first common
   token of a pair stands behind at most as many tokens of either set as may be
   missing from the other, given both sizes.
5. Reverse hash order: the last k(a) + 1 tokens must share one; checked on the
   candidate pair before the whole sets are intersected.

Pairs of a token are not enumerated: first each class is compared with the
token's leader among classes of about its size (the one whose tokens are the most
shared, for some tokens any) and the links are united. Then, in a further round, each
class outside a token's largest component meets one leader of that component,
another one for each token and round, and the links are united again: a round's
pairs are at most its postings. Only then the pairs of different components that
are left are enumerated, from the classes outside the
token's largest component. A token whose classes are one component needs no more
pairs; links within a component can't change the result and are not looked for.

Token counts are taken in slices by token, so that the rows shuffled for them are
on disk for one slice at a time.

Defined cases: null or empty text and text without words has an empty set and
links with nothing; one or two words are one shingle; repeated rows link; a null
id never is the smallest. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import mix
from .common import connected_components, give_back_memory, let_go, release, stage, with_uid
from .shingles import buffers, shingle_sets

U = np.uint64
#: Parts in which the tokens are counted, one after the other.
SLICES = 4
#: Rounds of leaders before what is left is enumerated; the result does not depend on it.
ROUNDS = 1
#: Tokens sent to Spark at once, so that its buffers outside the heap stay small.
SENT = 1 << 16


def _missing(a: int, percent: int) -> int:
    return a - -(-percent * a // 100)


def _extra(a: int) -> int:
    return -(-a // 10)


def _signatures(width: int, percent: int):
    """(uid, text bytes, id) -> (uid, n, s1, s2, prefix, id): set size, set signature, hash-order prefix."""

    def scan(batches):
        let_go()
        for b in batches:
            uid = b.column(0)
            n, s1, s2, pre = [], [], [], []
            for _, part in buffers([t or b"" for t in b.column(1).to_pylist()]):
                for s in shingle_sets(part, width):
                    m = mix(s)
                    n.append(len(s))
                    s1.append(int(m.sum(dtype=np.uint64)))
                    s2.append(int(mix(m ^ U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)))
                    pre.append(s[:min(len(s), _missing(len(s), percent) + _extra(len(s)))].tobytes())
            yield pa.RecordBatch.from_arrays(
                [uid, pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)),
                 pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(pre, pa.binary()), b.column(2)],
                names=["uid", "n", "s1", "s2", "prefix", "id"])
        give_back_memory()
    return scan


def _explode_tokens_of(uid_name: str, tokens_name: str):
    """(uid, packed tokens) -> (h, uid)."""

    def scan(batches):
        let_go()
        for b in batches:
            uid = b.column(uid_name).to_numpy(zero_copy_only=False)
            pre = b.column(tokens_name).to_pylist()
            n = np.array([len(p) // 8 for p in pre], np.int64)
            h, of = np.frombuffer(b"".join(pre), np.int64), np.repeat(uid, n)
            for at in range(0, len(h), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(h[at:at + SENT]), pa.array(of[at:at + SENT])], names=["h", "uid"])
        give_back_memory()
    return scan


def _sets(width: int):
    def scan(batches):
        let_go()
        for b in batches:
            sets = []
            for _, part in buffers([t or b"" for t in b.column(1).to_pylist()]):
                sets += [s.tobytes() for s in shingle_sets(part, width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["uid", "tokens"])
        give_back_memory()
    return scan


def _verify(percent: int):
    """(a, b, ta, tb) -> linked pairs; the reverse order's prefixes must meet before the sets are intersected."""

    def scan(batches):
        let_go()
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                px, py = x[-(_missing(len(x), percent) + 1):], y[-(_missing(len(y), percent) + 1):]
                if not np.intersect1d(px, py, assume_unique=True).size:
                    keep.append(False)
                    continue
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])
        give_back_memory()
    return scan


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    ta = sets.select(F.col("uid").alias("a"), F.col("tokens").alias("ta"))
    tb = sets.select(F.col("uid").alias("b"), F.col("tokens").alias("tb"))
    return (pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
            .mapInArrow(_verify(percent), "a bigint, b bigint"))


def _rarest(entries: DataFrame, classes: DataFrame, take: str, size: str, name: str) -> DataFrame:
    """(uid, n, central, pos, h): of each class's (h, uid) entries the ``take`` rarest, without those no other class has.

    ``pos`` counts the class's rarer tokens, ``central`` is how many classes share
    its tokens on average: high for a text that others are copies of. The tokens
    are counted slice by slice.
    """
    shared = []
    for k in range(SLICES):
        some = entries.filter(F.pmod("h", F.lit(SLICES)) == k)
        common = some.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
        shared.append(stage(some.join(common, "h").select("uid", "df", "h"), f"{name}-shared"))
        release()
    own = (_union(shared).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t")).join(classes.select("uid", "n"), "uid")
           .withColumn("own", F.expr(f"cast({size} - size(t) as int)")).withColumn("left", F.expr(f"cast({take} - own as int)")))
    out = stage(own.filter("left > 0").select(
        "uid", "n", F.expr(f"aggregate(t, 0D, (s, x) -> s + x.df) / ({size})").alias("central"), "own",
        F.posexplode(F.expr("slice(t.h, 1, left)")).alias("i", "h")).select(
        "uid", "n", "central", (F.col("own") + F.col("i")).alias("pos"), "h"), name)
    release(*shared)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _pairs(x: DataFrame, y: DataFrame, fits, tried: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet at a token within the bounds and have not been compared."""
    x = x.select("h", F.col("uid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("c").alias("ca"))
    y = y.select("h", F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("cb"))
    return (x.join(y, "h").filter("ca <> cb").filter(fits)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                          percent: int = 90) -> DataFrame:
    """(uid, id, n_shingles, component_id, first), one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links; ``first`` marks one
    row of each component (of the smallest id; of equal ids the first row).
    ``percent`` is 80 or more.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be between 80 and 100")
    base = with_uid(docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("raw")))
    sig = base.select("uid", "raw", "id").mapInArrow(
        _signatures(width, percent),
        f"uid bigint, n bigint, s1 bigint, s2 bigint, prefix binary, id {dict(base.dtypes)['id']}")
    wide = stage(sig, "nj-prefixes")
    key = ["n", "s1", "s2"]
    sig = stage(wide.drop("prefix"), "nj-signatures")
    classes = stage(sig.filter("n > 0").groupBy(*key).agg(F.min("uid").alias("uid")), "nj-classes")
    heads = stage(wide.select("uid", "prefix").join(classes.select("uid"), "uid", "left_semi"), "nj-heads")
    release(wide)

    # sizes of the hash-order prefix and of the rarity-order prefix within it
    need = f"cast(ceil({percent} * n / 100) as bigint)"
    size = f"least(n, n - {need} + cast(ceil(n / 10) as bigint))"
    entries = heads.mapInArrow(_explode_tokens_of("uid", "prefix"), "h bigint, uid bigint")
    first = _rarest(entries, classes, f"{size} - cast(ceil({need} / 10) as bigint) + 1", size, "nj-first")
    release(heads)
    met = first.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    wanted = stage(first.join(met, "h", "left_semi").select("uid").distinct(), "nj-wanted")
    sets = stage(base.select("uid", "raw").join(wanted, "uid", "left_semi")
                 .mapInArrow(_sets(width), "uid bigint, tokens binary"), "nj-sets")
    release(first, wanted)
    post = _rarest(sets.mapInArrow(_explode_tokens_of("uid", "tokens"), "h bigint, uid bigint"), classes, f"n - {need} + 1", "n", "nj-postings")
    again = post.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    # two thirds of the tokens are led by their most central class, the others by any
    lead_by = F.when(F.pmod("h", F.lit(3)) < 2, F.col("central")).otherwise(F.xxhash64("uid").cast("double"))
    band = F.floor(F.log("n") / 0.1)
    banded = post.withColumn("band", band)
    leaders = banded.groupBy("h", "band").agg(F.max_by(F.struct("n", "uid", "pos"), F.struct(lead_by, -F.col("uid"))).alias("lead"),
                                              F.count("*").alias("m")).filter("m > 1")

    # what each set may lack of the other, given both sizes, bounds the place of their first common token
    both = f"cast(ceil({percent} * (na + nb) / {100 + percent}) as bigint)"
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND pa <= na - {both} AND pb <= nb - {both}")
    star = stage(banded.join(leaders, ["h", "band"]).select(
        F.col("lead.uid").alias("a"), F.col("uid").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"),
        F.col("lead.pos").alias("pa"), F.col("pos").alias("pb"))
        .filter("a <> b").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "nj-star")
    links = stage(_linked(star, sets, percent), "nj-links")
    comp = connected_components(links, "nj-cc").withColumnRenamed("node", "uid")
    member0 = stage(post.join(again, "h", "left_semi").join(comp, "uid", "left")
                    .select("h", "uid", "n", "pos", F.coalesce("component", "uid").alias("c0")), "nj-members")
    # links found later join components of the first ones: few rows, in terms of components
    tried, later, joined = [star], [], None

    def now(t: DataFrame) -> DataFrame:
        if joined is None:
            return t.withColumn("c", F.col("c0"))
        return t.join(joined, t["c0"] == joined["node"], "left").withColumn("c", F.coalesce("component", "c0")).drop("node", "component")

    for turn in range(ROUNDS + 1):
        member = now(member0).select("h", "uid", "n", "pos", "c")
        mixed = (member.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h")
                 .agg(F.count("*").alias("g"), F.max_by("c", F.struct("k", "c")).alias("major")).filter("g > 1"))
        inside = member.join(mixed.select("h", "major"), "h")
        minor = inside.filter("c <> major").drop("major")
        hub = (inside.filter("c = major").groupBy("h").agg(F.max_by(F.struct("uid", "n", "pos", "c"), F.xxhash64("uid", "h", F.lit(turn))).alias("l"))
               .select("h", "l.*"))
        pairs = stage(_pairs(minor, hub if turn < ROUNDS else member, fits, _union(tried)), "nj-round")
        more = stage(_linked(pairs, sets, percent), "nj-links")
        tried.append(pairs)
        if not more.isEmpty():
            later.append(more)
            ends = _union(later)
            for end in ("a", "b"):
                ends = ends.join(comp.select(F.col("uid").alias(end), F.col("component").alias("c" + end)), end, "left")
            joined = stage(connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "nj-cc"), "nj-joined")
        release()

    found = now(classes.join(comp, "uid", "left").select(*key, F.coalesce("component", "uid").alias("c0"))).select(*key, "c")
    found = stage(found, "nj-found")
    release(sets, post, *tried, links, *later, member0)
    rows = sig.select("uid", *key, "id")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    # one row for each class, then for each component; the rows meet their class again
    per_class = rows.filter("n > 0").groupBy(*key).agg(F.min(order).alias("low")).join(found, key)
    per_comp = per_class.groupBy("c").agg(F.min("low").alias("low"))
    of_class = stage(per_class.select(*key, "c").join(per_comp, "c").select(*key, "low"), "nj-low")
    return (rows.join(of_class, key, "left").select(
        "uid", F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("low.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("low.uid") == F.col("uid")).otherwise(F.lit(True)).alias("first")))
