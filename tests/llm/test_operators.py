"""Corpus operators against brute force, SQL, exact round trips and held-out accuracy; edge cases of each."""

import collections
import glob
import hashlib
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from corvine.llm import queries as Q
from corvine.llm.chat_format import PART, formatted, format_turn, read_back, read_turn, PartVisitor
from corvine.llm.decontamination import contamination, decontaminated, item_words
from corvine.llm.html_extract import extracted, main_text
from corvine.llm.jaccard_join import Join, jaccard_groups, keep_one
from corvine.llm.language_id import identify, train
from corvine.llm.line_dedup import line_dedup, line_dedup_report
from corvine.llm.mixing import fit, knapsack, mix_plan, mixed, targets
from corvine.llm.quality import kept_rows, quality
from corvine.llm.sharding import sharded
from corvine.llm.substring_dedup import read_index, substring_dedup, update_index

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, size int"
LONG = " ".join(f"w{k}" for k in range(30_000))
BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    p = " ".join(f"x{k}" for k in range(40))
    data = [
        (1, p, "en", "a", 5, "k", 7, 3), (1, p, "en", "a", 5, "k", 7, 3), (2, p, None, None, None, None, None, None), (BIG, LONG, "en", "a", 1, "k", 1, 1), (None, p, "en", "b", 1, "k", 1, 1),
        (None, None, None, None, None, None, None, None), (3, "", "en", "b", 0, "", 0, 0), (4, " \n\t ", "en", "b", 0, "", 0, 0), (5, "one", "en", "é", 3, "k", 1, 1),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, duck, name):
    df, rel = Q.QUERIES[name](spark, SF), duck.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, rel.project(", ".join(names)).fetchall()))


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        contamination(none, bench), substring_dedup(none), mix_plan(none), jaccard_groups(none), line_dedup_report(none), sharded(none), quality(none), identify(none, train([], [])),
        extracted(spark.createDataFrame([], "page_id long, url string, html string")), read_back(formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    ):
        assert df.count() == 0


def test_decontamination_edges(spark, odd):
    bench = spark.createDataFrame([(1, "X1 x2, x3"), (2, None), (None, "one"), (3, " ".join(f"x{k}" for k in range(15)))], "item_id long, text string")
    got = contamination(odd, bench).collect()
    assert len(got) == 9 and {r.doc_id for r in got} == {1, 2, BIG, None, 3, 4, 5}
    first = next(r for r in got if r.doc_id == 2)
    assert (first.n_words, first.n_hit, first.items) == (40, 15, ["1", "3"])
    assert next(r for r in got if r.doc_id == 5).items == ["null"]
    clean = decontaminated(odd, bench)
    assert clean.columns == odd.columns and contamination(clean, bench).where("n_hit > 0").count() == 0


def test_decontamination_blocks(spark, monkeypatch):
    """Many blocks in several turns find what one block finds."""
    from corvine.llm import decontamination as D

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = sorted(map(repr, contamination(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", bench.selectExpr("sum(length(text))").first()[0] // 12)
    monkeypatch.setattr(D, "TURN", 2)
    assert sorted(map(repr, contamination(docs, bench).collect())) == one


def test_substring_edges(spark, odd, tmp_path):
    got = substring_dedup(odd).collect()
    assert len(got) == 9
    assert all(r.n_removed == (40 if r.n_words == 40 else 0) for r in got)
    path = str(tmp_path / "ix")
    for k in range(3):
        update_index(odd.where("doc_id = 2"), path, keep_runs=2)
    assert read_index(spark, path).select("run").distinct().count() == 1
    assert substring_dedup(odd.where("doc_id = 2"), index=read_index(spark, path)).first().n_removed == 40


def test_substring_index_partitions(spark, tmp_path):
    """An index goes on under other numbers of shuffle partitions, and a lost update leaves the version before it."""
    path = str(tmp_path / "ix")
    text = lambda k: " ".join(f"p{k}_{j}" for j in range(60))
    batch = lambda *ks: spark.createDataFrame([(k, text(k)) for k in ks], "doc_id long, text string")
    gone = lambda n: {r.doc_id: r.n_removed for r in substring_dedup(batch(*range(n + 1)), index=read_index(spark, path)).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert gone(0) == {0: 0}
    try:
        for k, n in enumerate((8, 3, 5, 4)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            update_index(batch(k), path, keep_runs=2)
            assert gone(k + 1) == {j: 60 * (j <= k) for j in range(k + 2)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # A run without a manifest that names it, as of a job that ended in between.
    read_index(spark, path).select("bucket", "prints", "checks").write.parquet(f"{path}/runs/lost")
    assert gone(4) == {j: 60 * (j < 4) for j in range(5)}


def test_substring_verified():
    """Windows of an equal hash and another check are met and turned down."""
    import numpy as np

    from corvine.llm.substring_dedup import Run, RunIndex

    u = lambda *x: np.array(x, np.uint64)
    index = RunIndex()
    index.add(Run.sorted(u(9, 5, 5), u(1, 1, 2)))
    index.add(Run.sorted(u(5, 5, 9, 9), u(2, 3, 1, 4)))
    index.add(Run.sorted(u(7, 5), u(1, 3)))
    again = index.repeats()
    assert sorted(zip(again.prints.tolist(), again.checks.tolist())) == [(5, 2), (5, 3), (9, 1)]


def test_substring_hot_windows():
    """A window that many batches send is noted once, and a bucket's runs follow its windows, not the batches."""
    import numpy as np
    import pandas as pd

    from corvine.llm import substring_dedup as S
    from corvine.llm.common import low, unpacked

    class Counted(S.RunIndex):
        made = []

        def repeats(self):
            self.made.append((super().repeats(), len(self.runs)))
            return self.made[-1][0]

    n, rows = 300, []
    for k in range(n):
        # Windows 1 and 2 share a hash and are in all batches; 3 is in none but this and the next one.
        prints, checks = np.array([1000 + k, 7, 7, 8 + (k // 2)], np.uint64), np.array([1, 2, 1, 3], np.uint64)
        rows.append((5, np.int64(k).tobytes(), None, None, S._steps(np.arange(4)), low(prints, 6), low(checks, 3)))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(S, "RunIndex", Counted)
        for least in (1 << 17, 10):
            patch.setattr(S, "RUN_WINDOWS", least)
            got = S._probe(pd.DataFrame(rows, columns=[c.split()[0] for c in S.RUN.split(", ")]), 3)
            marks = [x for r in got.itertuples() for x in zip(*(v.tolist() for v in unpacked(r.keys, r.counts, r.places)), strict=True)]
            assert sorted(marks) == [(k, p) for k in range(n) for p in (1, 2, 3)]
    assert [len(x) for x, _ in Counted.made] == [2 + n // 2] * 2 and Counted.made[0][1] == 1


def test_substring_sent_bytes():
    """What a batch sends for a window does not grow with the number of buckets."""
    import zlib

    import numpy as np
    import pandas as pd

    from corvine.llm import substring_dedup as S

    rng = np.random.default_rng(3)
    texts = [None, "", *(" ".join(map(str, rng.integers(0, 1 << 40, 300))) for _ in range(400))]
    frame = pd.DataFrame({"key": rng.integers(-(1 << 62), 1 << 62, len(texts)), "text": texts})
    size = []
    for buckets in (8, 600):
        (out,) = S._runs(iter([frame]), 35, buckets)
        of = out[out["prints"].notna()]
        size.append(sum(len(x) for c in ("prints", "checks") for x in of[c]) + len(zlib.compress(b"".join(of["places"]), 1)))
        assert len(out) == buckets + 1 and out["docs"].notna().sum() == 1
        marks = of.assign(bucket=0)
        assert not len(S._placed(S._probe(out, 1)))
        # The same batch once more: all its windows repeat, at their places in their own texts.
        got = S._placed(S._probe(pd.concat([out, marks]), 1)).set_index("key")["places"]
        assert sorted(got.index) == sorted(frame["key"][2:]) and all(S.unplanes(x, "<u4").tolist() == list(range(266)) for x in got)
    assert size[1] < 1.2 * size[0]


def test_substring_repeated_rows(spark):
    """Rows that repeat, in one batch and in several, come out once each."""
    p = " ".join(f"x{k}" for k in range(50))
    rows = [(1, p), (1, p), (2, "a " + p), (3, " ".join(f"y{k}" for k in range(50))), (4, None)]
    got = substring_dedup(spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted([(1, 50), (1, 50), (2, 51), (3, 50), (4, 0)] * 2)


def test_substring_spread(spark, docs, monkeypatch):
    """More buckets than shuffle partitions and many runs in each: the same rows, in as many tasks."""
    from corvine.llm import substring_dedup as S

    want = sorted(map(repr, substring_dedup(docs, width=5).collect()))
    chars = docs.selectExpr("sum(length(text))").first()[0]
    for name, value in (("BUCKET_CHARS", chars // 20), ("RUN_WINDOWS", 100)):
        monkeypatch.setattr(S, name, value)
    seen = []
    monkeypatch.setattr(S, "spread", lambda df, n, column, real=S.spread: seen.append((column, real(df, n, column).rdd.getNumPartitions())) or real(df, n, column))
    assert sorted(map(repr, substring_dedup(docs, width=5).collect())) == want
    assert seen[0] == ("bucket", 21) and ("key", 21) in seen


def test_mixing_edges(spark, odd):
    rows = mix_plan(odd).collect()
    assert len(rows) == 9 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mix_plan(odd).collect()))
    assert mixed(odd).columns == odd.columns and mixed(odd).count() == sum(r.copies for r in rows)


def test_mixing_targets(spark):
    rows = mix_plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    by = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert abs(by.target.sum() - 1.5 * rows["size"].sum()) < 1e-6
    assert ((by.target - by.taken).abs() <= 2).all() and (by.target <= 2 * by["size"] + 1e-9).all()


def brute_targets(sizes):
    """{source: target} by resharing, in rounds, what is above twice a source's size."""
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[x] for x in free)
        over = {x for x in free if left * weight[x] / total > 2 * sizes[x]}
        if not over:
            return out | {x: left * weight[x] / total for x in free}
        for x in over:
            out[x] = 2.0 * sizes[x]
        left, free = left - sum(out[x] for x in over), free - over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 100, None: 40}, {"é": 7, "z": 900, "Z": 30, "a": 0, "b": 55, "c": 13, "d": 200}, {"a": 5}])
def test_targets_brute(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mixing_draws(spark):
    """Every document is taken as often as its source's whole copies, or once more; sums come within one shortest document of the target."""
    rows = mix_plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    sizes = rows.groupby("source", dropna=False)["size"].sum().to_dict()
    want = brute_targets({None if x != x else x: v for x, v in sizes.items()})
    for source, part in rows.groupby("source", dropna=False):
        target = part.target.iloc[0]
        assert target == pytest.approx(want[None if source != source else source])
        whole = int(target // part["size"].sum())
        assert set(part[part["size"] > 0].copies) <= {whole, whole + 1} and (part.copies <= 2).all()
        spare = part[(part.copies == whole) & (part["size"] > 0)]["size"]
        assert abs(target - part.taken.sum()) <= max(1, spare.min() if len(spare) else 1)


def test_knapsack():
    import itertools

    for budget in range(40):
        best = max(s for s in (3 * a + 5 * b + 7 * c for a, b, c in itertools.product(range(3), range(2), range(5))) if s <= budget)
        got = knapsack([3, 5, 7], [2, 1, 4], budget)
        assert sum(x * y for x, y in zip(got, [3, 5, 7])) == best and all(x <= y for x, y in zip(got, [2, 1, 4]))


def test_fit_many_lengths():
    import numpy as np

    lengths = np.array(sorted([*range(1000, 1402, 2), 1203]))
    assert (fit(lengths, np.ones_like(lengths), 2203.0) * lengths).sum() == 2203
    even = np.arange(2, 40_000, 2)
    assert (fit(even, np.ones_like(even), 30_001.0) * even).sum() == 30_000
    long = np.array([80_000, 90_000])
    assert (fit(long, np.ones_like(long), 95_000.0) * long).sum() == 90_000


def test_jaccard_edges(odd):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(odd, 3, 90).collect()}
    assert got == {(1, 38, 1), (2, 38, 1), (BIG, 29_998, BIG), (None, 38, None), (None, 0, None), (3, 0, 3), (4, 0, 4), (5, 1, 5)}
    assert keep_one(odd, 3, 90).where("doc_id = 2").count() == 0 and keep_one(odd, 3, 90).columns == odd.columns


def test_jaccard_chain(spark):
    """Each text links with the next one only: one component through the chain."""
    words = [f"v{k}" for k in range(200)]
    chain = spark.createDataFrame([(k, " ".join(words[4 * k : 4 * k + 120])) for k in range(20)], "doc_id long, text string")
    assert {r.component_id for r in jaccard_groups(chain, 3, 90).collect()} == {0}


def brute_groups(rows, width, percent):
    """{doc_id: component_id} by all pairs of rows (doc_id, text)."""
    sets = []
    for i, text in rows:
        w = (text or "").lower().split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and (i == j or 100 * len(x & y) >= percent * len(x | y)):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up}


def test_jaccard_repeated_ids(spark):
    """Rows of one id link their texts, whichever of them a batch meets first."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (9, a + " more"), (7, b + " more"), (6, "")]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.component_id for r in jaccard_groups(spark.createDataFrame(order, "doc_id long, text string"), 3, 90).collect()}
        assert got == {5: 5, 9: 5, 7: 5, 6: 6}


@pytest.mark.parametrize("piece", [500_000, 20])
def test_jaccard_crowd(spark, piece):
    """A large group of short near texts around one text, some of them near each other only, with columns in one piece and in many."""
    import random

    rng = random.Random(3)
    base = [f"b{k}" for k in range(50)]
    rows = []
    for i in range(160):
        words = base[:]
        for _ in range(rng.choice((0, 1, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = f"n{rng.randrange(400)}"
        if rng.random() < 0.3:
            del words[rng.randrange(len(words))]
        rows.append((i, " ".join(words)))
    for width, percent in ((3, 90), (5, 80), (1, 100)):
        got = {r.doc_id: r.component_id for r in Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, percent, piece).documents().collect()}
        assert got == brute_groups(rows, width, percent)


def test_keep_one_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "A b c", 4, 5, 6), (3, "other", 7, 8, 9)], "doc_id long, text string, _gone long, _own_0 long, component_id long")
    left = keep_one(rows)
    assert left.columns == rows.columns and sorted(map(tuple, left.collect())) == [(1, "a b c", 1, 2, 3), (3, "other", 7, 8, 9)]


def test_jaccard_long_groups(spark):
    """Two groups of near copies above 1500 shingles, one a shortened version of the other; the largest group varies by column."""
    words = [f"u{k}" for k in range(2802)]
    texts = {}
    for group, (n, own) in enumerate(((2536, 100), (2802, 600))):
        for k in range(4):
            w = words[:n]
            # The last copy differs in 15 words, the others in one each.
            for at in range(own, own + 300, 20) if k == 3 else [1200 + 500 * group + 40 * k]:
                w[at] = f"{group}-{k}-{at}"
            texts[10 * group + k] = w
    sets = {d: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for d, w in texts.items()}
    least = {d: d for d in sets}
    for _ in sets:
        for a, b in ((a, b) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])):
            least[a] = least[b] = min(least[a], least[b])
    assert set(least.values()) == {0}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_groups(rows, 3, 90).collect()} == least


def brute_lines(rows, min_words=8, min_chars=16):
    """{doc_id: numbers of removed lines} of rows (doc_id, text) in order, by edit distance to every earlier line."""

    def units(line):
        w = line.split()
        return ("w", tuple(w)) if len(w) >= min_words else ("c" if len(" ".join(w)) >= min_chars else "e", tuple(" ".join(w)))

    def near(a, b):
        if a == b:
            return True
        if a[0] != b[0] or a[0] == "e":
            return False
        x, y = sorted((a[1], b[1]), key=len)
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y)) == 1
        return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    earlier, out = [], {}
    for doc, text in rows:
        out[doc] = []
        for k, line in enumerate(text.split("\n")):
            if line.split():
                if any(near(units(line), e) for e in earlier):
                    out[doc].append(k)
                earlier.append(units(line))
    return out


def test_line_dedup_brute(spark):
    """Edits at every place, of words and of characters, lengths at the bounds, against edit distance to all earlier lines."""
    import random

    rng = random.Random(5)
    lines = []
    for n in (1, 2, 3, 7, 8, 9, 10, 15):
        base = [f"w{n}x{k}" for k in range(n)]
        lines.append(" ".join(base))
        for k in range(n):
            lines += [" ".join(base[:k] + base[k + 1 :]), " ".join([*base[:k], "other", *base[k + 1 :]]), " ".join([*base[:k], "more", *base[k:]])]
            lines.append(" ".join([*base[:k], base[k][:-1], *base[k + 1 :]]))
            lines.append(" ".join([*base[: k // 2], "two", *base[k // 2 + 1 : k], "changes", *base[k + 1 :]]))
    lines += ["fifteen chars ab", "fifteen chars ac", "fifteen chars a", "sixteen  chars abc", "sixteen chars abd", "sixteen chars ab", " ", "", "é" * 16, "é" * 15 + "è"]
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[7 * k : 7 * k + 7])) for k in range((len(lines) + 6) // 7)]
    want = brute_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.text.split("\n") for r in line_dedup(df).collect()}
    assert got == {i: [x for k, x in enumerate(t.split("\n")) if k not in want[i]] or [""] for i, t in rows}
    report = {r.doc_id: (r.n_removed, r.removed_sha256) for r in line_dedup_report(df).collect()}
    assert report == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in want.items()}


def test_line_dedup(spark, docs, odd):
    seen, cut, near, gone = set(), set(), set(), collections.Counter()
    for r in docs.orderBy("doc_id").collect():
        for line in r.text.split("\n"):
            w = tuple(line.encode().split())
            if not w:
                continue
            # Shorter lines go by their characters; a mark in front keeps the two kinds apart.
            if many := len(w) >= 8:
                w = (0, *w)
            else:
                many, w = len(b" ".join(w).decode()) >= 16, (1, *b" ".join(w).decode())
            short = [w[:k] + w[k + 1 :] for k in range(1, len(w))] if many else []
            least = 9 if w[0] == 0 else 17
            gone[r.doc_id] += w in seen or (many and w in cut) or any((v, k) in near for k, v in enumerate(short)) or any(len(v) >= least and v in seen for v in short)
            seen.add(w)
            cut.update(short)
            near.update((v, k) for k, v in enumerate(short))
    assert {r.doc_id: r.n_removed for r in line_dedup_report(docs).collect()} == {r.doc_id: gone[r.doc_id] for r in docs.collect()}
    assert line_dedup(odd).count() == 9 and line_dedup_report(odd).where("doc_id = 2 and n_removed = 1").count() == 1


def test_line_dedup_copies(spark):
    """Lines that are only equal to others are settled by the hash of the whole line: but for the earliest copy, none sends its variants."""
    import random

    rng = random.Random(3)
    shared = [" ".join(f"{rng.getrandbits(20):x}" for _ in range(300)) for _ in range(40)]
    rows = [(k - 5, "\n".join([f"only here {k} {k}", *rng.sample(shared, 40)])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12).cache()
    assert df.count() == 12

    def moved():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = moved()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all copies are in one task
    try:
        assert {r.doc_id: r.n_removed for r in line_dedup_report(df).collect()} == {i: 40 * (i > -5) for i, _ in rows}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Texts are moved once; the variants of 40 lines have 40 * 301 * 16 bytes of hashes, and several times these if more than one task sends them.
    sent, texts = moved() - before, sum(len(t) for _, t in rows)
    df.unpersist()
    assert sent < texts + 2 * 40 * 301 * 20


def test_line_dedup_copies_brute(spark):
    """Copies and near copies of few lines, many times over many partitions, ids below 0, rows that repeat."""
    import random

    rng = random.Random(11)
    pool = []
    for n in (3, 8, 9, 14):
        base = [f"word{n}x{k}" for k in range(n)]
        pool += [" ".join(base), "  ".join(base), " ".join([*base, "more"]), " ".join(base[1:]), " ".join(["other", *base[1:]]), " ".join([*base[:-1], "last"]), " ".join([*base[:-2], "two", "changes"])]
    pool += ["short", "short line", " ", ""]
    for _ in range(4):
        rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in rng.sample(range(-(10**12), 10**12), 40)]
        want = brute_lines(sorted(rows))
        again = [*rows, *rng.sample(rows, 5)]
        rng.shuffle(again)
        report = line_dedup_report(spark.createDataFrame(again, "doc_id long, text string").repartition(9)).collect()
        assert len(report) == 45
        assert all((r.n_removed, r.removed_sha256) == (len(x := want[r.doc_id]), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for r in report)


def test_planes_of_runs():
    import numpy as np

    from corvine.llm.common import planes, planes_of, unplanes_of

    rng = np.random.default_rng(2)
    for size in ([], [0], [3], [0, 5, 0, 1, 7, 0], [1] * 50):
        cuts = np.append(0, np.cumsum(size, dtype=np.int64))
        for kind, low, high in (("<u4", 0, 2**32), ("<i8", -(2**63), 2**63)):
            values = rng.integers(low, high, cuts[-1], dtype=np.int64)
            parts = planes_of(values, kind, cuts)
            assert parts == [planes(values[a:b], kind) if a < b else b"" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            back, sizes = unplanes_of(parts, kind)
            assert back.tolist() == values.tolist() and sizes.tolist() == size


def test_line_dedup_scanned(monkeypatch):
    """The first pass sees the lines that the second one does, equal words alike, and hashes no word of longer lines one by one."""
    import random

    import numpy as np

    from corvine.llm import line_dedup as L

    rng, bits = random.Random(1), ["a", "b", "é", "\x1c", "\x85", "\xa0", "\ud800", "\0", "x" * 64, "x" * 65, "y" * 65, "abcdefgh", "abcdefghi", "😀", *[" ", "\n", "\t", "\x0b", "\r", "  "] * 3]
    texts = [None, "", " ", "\n\n", "a\n", " a b\n\nc ", *("".join(rng.choices(bits, k=rng.randrange(150))) for _ in range(300))]
    rng.shuffle(texts)
    for some in (texts, texts[:1], [None], ["\n"], [None, "a"], ["a", None]):
        one, other = L.Lines(some, None, 8, 16), L.Lines.scanned(some, 8, 16)
        assert all(np.array_equal(getattr(one, c), getattr(other, c)) for c in ("doc", "number", "lens", "fuzzy", "salt"))
        kind = np.repeat(one.salt, one.lens).tolist()
        both = set(zip(kind, one.hashes.tolist(), other.hashes.tolist(), strict=True))
        assert len(both) == len({x[:2] for x in both}) == len({x[::2] for x in both})
    seen = []
    monkeypatch.setattr(L, "hashed_words", lambda units, split, real=L.hashed_words: seen.extend(units) or real(units, split))
    long = " ".join(f"w{k}" for k in range(20))
    lines = L.Lines.scanned([f"{long}\nab cd\n{long} more"], 8, 16)
    assert seen == [[b"a", b"b", b" ", b"c", b"d"]] and lines.lens.tolist() == [20, 5, 21] and (lines.hashes[:20] == lines.hashes[25:45]).all()


def test_line_dedup_shared_ids(spark):
    """Of many documents without an id, and many of one id, each loses its own repeated line and no other."""
    own = {k: [f"own {k} {j}" for j in range(k % 7 + 1)] for k in range(4000)}
    rows = [(7 if k % 2 else None, "\n".join([*x[: k % 5], "common line", *x[k % 5 :]])) for k, x in own.items()]
    got = line_dedup(spark.createDataFrame([*rows, (1, "first\ncommon line")], "doc_id long, text string")).collect()
    assert sorted(x for r in got for x in r.text.split("\n")) == sorted(["first", "common line", *(x for lines in own.values() for x in lines)])


def test_sharding(docs, odd):
    def jump(key, n):
        b, j, key = -1, 0, key & (2**64 - 1)
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = sharded(docs).collect()
    assert all(r.shard == jump(r.doc_id, 8) and r.grown_shard == jump(r.doc_id, 9) and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    slots = collections.defaultdict(list)
    for r in sharded(odd).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 9


def test_quality(docs, odd):
    got = {r.doc_id: r for r in quality(docs).collect()}
    for d in docs.collect():
        w = d.text.encode().split()
        count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in d.text.split("\n") if x.split()]
        r = got[d.doc_id]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(hit), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(c in "#*$%&|<>" for c in d.text)
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
    assert quality(odd).count() == 9 and kept_rows(odd).columns == odd.columns


def test_language_held_out(spark):
    got = Q.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_language_unknown(odd):
    import numpy as np

    model = train([(np.array([1]), np.array([3]))] * 10, ["en"] * 5 + ["fr"] * 5)
    rows = identify(odd, model).collect()
    assert len(rows) == 9 and sum(r.lang_pred == "und" for r in rows) == 3


def test_html():
    page = '<html><body><nav><a href="/">menu</a></nav><div class="ad">buy</div><article><h1>T &amp; U</h1><p>One <b>two\n three<p>four &lt;five&gt;<br>six</article><div id="comments"><p>reader</p></div><footer>foot</footer>'
    assert main_text(page) == "T & U\n\nOne two three\n\nfour <five> six"
    assert main_text(None) == main_text("") == main_text("<script>x</script>") == ""


def test_chat_round_trip(spark):
    for text in ("<|end|>", "a<\\|b", "<|turn|>user\nx", "<", "<\\", "\\### Assistant: </turn> ok", ""):
        piece, a, b, _ = format_turn("assistant", [{"type": "text", "text": text}], PartVisitor())
        assert read_turn(piece) == ("assistant", text)
    for role in ("a\nb", "a\\n", "<|end|>", None):
        assert read_turn(format_turn(role, [], PartVisitor())[0])[0] == (role or "")
    parts = spark.createDataFrame([(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "u1", 56, 30, None, None), ("audio", None, "u2", None, None, 2.0, None), ("document", None, "u3", None, None, None, 2)])], f"conv_id long, turn long, role string, parts array<{PART}>")
    r = formatted(parts).first()
    assert r.piece == "<|turn|>user\nsee <|image:0|><|audio:1|><|document:2|><|end|>\n"
    assert [(a.ref, a.tokens) for a in r.attachments] == [("u1", 4), ("u2", 50), ("u3", 1024)]
    turns = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "x"), (None, 0, "user", "y"), (1, None, "user", "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_back(formatted(turns)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\nz\n\nx\nassistant\n\n").hexdigest() and got[None].n_turns == 1


def test_pipeline(spark, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == docs.columns and rows.count() > 0
    bench = {tuple(w[k : k + 10]) for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() for w in [item_words(t)] for k in range(len(w) - 9)}
    assert not any(tuple(w[k : k + 10]) in bench for r in rows.collect() for w in [item_words(r.text)] for k in range(len(w) - 9))
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()


def test_pipeline_run(spark, docs):
    """run() gives what its stages give one after the other, by plain reading of each one's verdicts."""
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality(docs).collect() if r.kept}
    groups = brute_groups([(i, rows[i].text) for i in sorted(kept)], 5, 80)
    texts = {i: rows[i].text for i in kept if groups[i] == i}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = decontaminated(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), bench)
    source = spark.createDataFrame([(i, rows[i].source) for i in texts], "doc_id long, source string")
    plan = mix_plan(clean.join(source, "doc_id")).collect()
    want = collections.Counter({r.doc_id: r.copies for r in plan if r.copies})
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in got) == want and all(0 <= r.shard < 8 for r in got)


def test_pipeline_odd(spark, odd, none):
    """Each stage takes nulls, empty texts, repeated rows, clashing columns and an empty table."""
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            if name != "sharding":
                assert out.columns == df.columns
            assert out.count() <= 2 * df.count()



PAGES = {
    # No class names and no telling tags: only density tells the parts apart.
    "bare": (
        "<body><div><div><a href=1>Home</a> <a href=2>News of the day</a> <a href=3>Sports and more</a></div></div><div>Buy this now</div><div><h2>Title</h2>"
        + "".join(f"<p>Paragraph {k} {'with a good many plain words in it ' * 6}</p>" for k in range(4)) + "</div><div>The end</div></body>",
        ["Title", *(" ".join(f"Paragraph {k} {'with a good many plain words in it ' * 6}".split()) for k in range(4))],
    ),
    # Names that lie: a wrapper and a title whose classes have words of boilerplate.
    "lies": (
        '<body><div class="content-sidebar-wrap header-fixed"><article class="post has-sidebar"><div class="article-header"><h1>The title</h1></div><p>' + "some text of the article " * 9 + '</p></article></div><div class="sidebar">other things</div></body>',
        ["The title", " ".join(("some text of the article " * 9).split())],
    ),
    # Reader comments as articles, in a section with a name and by their own.
    "comments": (
        "<body><main><article><header><h1>Head</h1></header><p>" + "the body of it " * 12 + '</p><article class="comment"><p>' + "I do not agree " * 20 + '</p></article></article></main><section id="comments"><article><p>' + "me neither, " * 30 + "</p></article></section></body>",
        ["Head", " ".join(("the body of it " * 12).split())],
    ),
    # A list of links inside the article goes, a list of words stays.
    "lists": (
        "<body><article><p>" + "plain words here " * 15 + "</p><ul><li>one</li><li>two</li></ul><div><a href=1>Read this as well</a><a href=2>And this</a></div><p>" + "more plain words " * 15 + "</p></article></body>",
        [" ".join(("plain words here " * 15).split()), "one", "two", " ".join(("more plain words " * 15).split())],
    ),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_density_pages(name):
    page, want = PAGES[name]
    assert main_text(page).split("\n\n") == want


def test_density_decides(monkeypatch):
    """With the same density everywhere, the bare page and the list of links come out wrong."""
    from corvine.llm import html_extract as H

    def flat(order):
        for n in order:
            n.density = n.total = 1.0

    monkeypatch.setattr(H, "_weigh", flat)
    assert all(main_text(PAGES[name][0]).split("\n\n") != PAGES[name][1] for name in ("bare", "lists"))


def test_density_brute(spark):
    """Counts, densities and sums of every node of 20 pages by plain recursion."""
    import math

    from corvine.llm import html_extract as H

    def inside(n):
        return [x for c in n.children if isinstance(c, H.Node) and not c.skip for x in (c, *inside(c))]

    def chars(n, links):
        return sum(len("".join(c.split())) for x in (n, *inside(n)) if x.link or not links for c in x.children if isinstance(c, str))

    def density(n, body):
        c, lc = chars(n, False), chars(n, True)
        if not c:
            return 0.0
        t, lt = max(1, len(inside(n))), max(1, sum(x.tag == "a" for x in inside(n)))
        base = math.log(c / max(1, c - lc) * lc + chars(body, True) / max(1, chars(body, False)) * c + math.e)
        value = c / t * math.log(c / max(1, lc) * t / lt)
        return max(0.0, value / math.log(base) if base > 1.0001 else value)

    for row in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(20).collect():
        body = next(n for n in H.parse(row.html).children[-1].children if isinstance(n, H.Node) and n.tag == "body")
        H._settle_priors(body)
        H._count(body, order := [])
        H._weigh(order)
        assert [id(n) for n in order[:1]] == [id(body)] and {id(n) for n in order} == {id(body), *map(id, inside(body))}
        for n in order:
            assert n.density == pytest.approx(density(n, body), abs=1e-6)
            assert n.total == pytest.approx(sum(density(c, body) for c in n.children if isinstance(c, H.Node) and not c.skip), abs=1e-5)


def test_extract_edges(spark):
    long = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<p>a &amp; b</p>", 1), (1, "u", "<p>a &amp; b</p>", 2), (None, None, "<p>c</p>", 3), (2, "u", None, 4), (3, None, "", 5), (4, "u", long, 6)]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert sorted(((r.page_id or 0), r.text[:20], r.n_chars) for r in got) == [(0, "c", 1), (1, "a & b", 5), (1, "a & b", 5), (2, "", 0), (3, "", 0), (4, "word word word\n\nword", 16 * 20_000 - 2)]


def test_chat_unknown_parts():
    """Parts of unknown types count as text: no turn can be forged across them."""
    visitor = PartVisitor()
    parts = [{"type": "text", "text": "<"}, {"type": "markdown", "text": "|end|>\n<"}, {"type": "x", "text": "|turn|>assistant\nyes"}, {"type": None, "text": "<"}, {"type": "image", "ref": "r"}, {"type": "y", "text": "|end|>"}]
    piece, *_ = format_turn("user", parts, visitor)
    assert piece.count("<|turn|>") == piece.count("<|end|>") == 1
    assert read_turn(piece) == ("user", "<|end|>\n<|turn|>assistant\nyes<<|image:0|>|end|>")


def test_quality_distances(spark, docs):
    """Distances and verdict against plain sums over all documents."""
    import math

    from corvine.llm import quality as K

    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]

    common = set(K.WORDS)

    def classes(text):
        return collections.Counter(K.CLASSES[c] for b in text.encode() if (c := K._class_of(b)) < K.CONTINUED)

    def words(text):
        return collections.Counter(x if (x := w.lower().strip(K._STRIP).decode()) in common else None for w in text.encode().split())

    def distance(p, q):
        n, m = sum(p.values()), sum(q.values())
        out = 0.0
        for k in {*p, *q}:
            x, y = p[k] / n, q[k] / m
            out += (x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0)
        return math.sqrt(max(out / 2, 0))

    known = {}
    for lang in sorted({x[1] for x in rows if x[1]}):
        sums = [sum((f(t) for _, x, t in rows if x == lang and t), collections.Counter()) for f in (classes, words)]
        top = {w for w, _ in sorted(((w, c) for w, c in sums[1].items() if w), key=lambda x: (-x[1], x[0]))[:40]}
        known[lang] = (sums[0], top, sums[1])
    cut = lambda counts, top: sum((collections.Counter({k if k in top else None: c}) for k, c in counts.items()), collections.Counter())
    got = {r.doc_id: r for r in quality(docs).collect()}
    for i, _, text in rows:
        r, c, w = got[i], classes(text), words(text)
        pairs = [(distance(c, a) if sum(c.values()) >= K.GUARD_CHARS else 0.0, distance(cut(w, top), cut(b, top)) if sum(w.values()) >= K.GUARD_WORDS else 0.0) for a, top, b in known.values()]
        far, near = min(pairs, key=sum)
        assert (r.class_distance, r.word_distance) == (pytest.approx(far, abs=1e-9), pytest.approx(near, abs=1e-9))
        limit = far > 0.26 + 1 / math.sqrt(max(1, sum(c.values()))) or near > 0.19 + 1.5 / math.sqrt(max(1, r.n_words))
        assert r.kept == (not r.base_failed and not limit)
