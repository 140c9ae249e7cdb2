"""Periodic runs, ranked search and SimHash groups against plain versions."""

import os
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import duckdb  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from telemetra.llm import periodic, queries, ranked, simhash  # noqa: E402

SMALL = "/root/testdata/sf0.001"
ODD = [
    (0, "a b c " * 9 + "tail"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "x " * 6),
    (6, "x " * 5),
    (7, "Ünï 中文 😀 " * 4 + "end"),
    (8, "a b c " * 9 + "tail"),
    (8, "p q p q p q p q r r r r r r"),
    (None, "a b " * 7),
    (None, "a b " * 7),
    (9, "w " * 30000 + "u v " * 5),
    (10, "A b C d e"),
    (11, "a B c D E"),
]
CLASHING = "doc_id long, text string, lang string, n int, mark int, terms int, score int, rank int, query int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", 1, 2, 3, 4, 5, 6) for r in ODD], CLASHING)


@pytest.fixture(scope="module")
def small():
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    return list(zip(table.doc_id.tolist(), table.text.tolist()))


def test_runs_of_random_lists():
    rng = np.random.default_rng(3)
    for turn in range(1500):
        a = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))
        if turn % 3 == 0 and len(a) > 12:
            low, q = int(rng.integers(0, 6)), int(rng.integers(1, 7))
            a[low:] = a[low:][np.arange(len(a) - low) % q]
        if turn % 5 == 0:
            block = rng.integers(0, 9, 5)
            a = np.r_[a, np.tile(block, 5), a, np.tile(block[:3], 6)]
        got = [
            (low + s, m, q)
            for low, high in periodic.stable_segments(a, np.array([0, len(a)]))
            for s, m, q in periodic.lag_scan(a[low:high])
        ]
        assert sorted(got) == brute.periodic(a.tolist())


def test_segments_are_split_again():
    """b is rare only once c has split the text, and a only after that."""
    code = np.array([0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 0, 1, 0, 3, 3, 3, 3, 3, 3])
    assert periodic.stable_segments(code, np.array([0, 13, 19])) == [(13, 19)]


def test_periodic_runs_of_odd_rows(docs):
    got = periodic.periodic_runs(docs)
    assert got.columns == [*docs.columns, "periodic"]
    want = []
    for doc, text in ODD:
        words = brute.SPACED.findall(text or "")
        runs = brute.periodic(words) if len(words) < 1000 else [(0, 30000, 1), (30000, 10, 2)]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        want.append((str(doc), len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    found = [
        (str(r["doc_id"]), r["periodic"]["n_words"], [tuple(x) for x in r["periodic"]["runs"]], r["periodic"]["collapsed"])
        for r in got.collect()
    ]
    assert sorted(found) == sorted(want)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    again = periodic.periodic_runs(got.filter("doc_id = 5"), into="periodic")
    assert again.columns == got.columns and again.first()["periodic"]["strongest"]["length"] == 6


def test_op11_on_the_small_table(spark, small):
    got = {r[0]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    assert got == {doc: brute.periodic_row(doc, text) for doc, text in small}
    assert sum(1 for r in got.values() if r[0]) > 10


ITEMS = [(1, "a b a"), (2, "Tail!"), (3, None), (None, "x w"), (1, "a b a"), (4, "nowhere"), (5, "中文 😀 e")]


@pytest.mark.parametrize("k", [3, 20])
def test_ranked_search_of_odd_rows(spark, docs, k, monkeypatch):
    items = spark.createDataFrame(
        [(*r, 0, "s") for r in ITEMS], "item_id long, text string, rank int, score string"
    )
    want = sorted(map(str, brute.ranked([r[:2] for r in ODD], ITEMS, k)))
    for size in (512, 2):  # one block of queries, and several
        monkeypatch.setattr(ranked, "BLOCK_ITEMS", size)
        got = ranked.search(docs, items, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(docs.limit(0), items).count() == 0


def test_pruning_keeps_ties_and_small_leaves(spark, monkeypatch):
    """Many equal scores, and documents dealt over many leaves, blocks and tasks."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)]
    rows = [(int(k), " ".join(rng.choice(words, rng.integers(1, 9)))) for k in rng.permutation(900)]
    items = [(int(k), " ".join(rng.choice(words, rng.integers(1, 6)))) for k in range(40)]
    monkeypatch.setattr(ranked, "BLOCK_CELLS", 1 << 10)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ranked.search(table, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.ranked(rows, items, 7))


def test_pairs_of_nodes_are_pruned(spark):
    """With k-th scores known, few leaves are scored."""
    rng = np.random.default_rng(9)
    topics = [[f"t{t}x{k}" for k in range(20)] for t in range(25)]
    texts = [" ".join(rng.choice(topics[k % 25], 30)) for k in range(2000)]
    block = ranked.Queries.of(ranked.item_terms([" ".join(rng.choice(t, 8)) for t in topics]))
    found = ranked.vectors(
        spark.createDataFrame(list(enumerate(texts)), "_doc long, text string"), block.terms
    )
    df = ranked.document_frequencies(found, len(block.terms))
    batch = pa.RecordBatch.from_pandas(found.toPandas(), preserve_index=False)
    weight = np.floor(1000 * np.log(4002 / (2 * df + 1))).astype(np.int64)
    search = ranked.Search(block, weight, 2000, 60000, 5, np.zeros(25, np.int64))
    docs = ranked._Documents(search, np.stack([block.counts[o].max(0) for o in block.cut(16)]), batch)
    best = ranked._Best(search)
    scored = []
    descent = ranked._Descent(search, docs, best)
    take = docs.entries
    docs.entries = lambda leaves: scored.append(len(leaves)) or take(leaves)
    descent.visit(0, len(docs.levels) - 1, np.zeros(1, np.int64))
    pairs = len(docs.levels[0]) * sum(c is None for c in block.children)
    assert 0 < sum(scored) < pairs / 3


def test_op12_on_the_small_table(spark, small):
    got = [tuple(r) for r in queries.op12_ranked_search(spark, SMALL).collect()]
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    want = brute.ranked(small, list(zip(items.item_id.tolist(), items.text.tolist())), 20)
    assert sorted(got) == sorted(want)
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"create view {name} as from '{SMALL}/{name}.parquet'")
        assert sorted(db.execute(queries.ORACLE_SQL["op12_ranked_search"]).fetchall()) == sorted(want)


def test_fingerprints():
    texts = [t for _, t in ODD] + ["one two three", "a b c d", "é " * 700]
    value, at = simhash.shingle_hashes(pa.array(texts), 4)
    got = simhash.fingerprints(value, at).tolist()
    assert got == [brute.fingerprint(t, 4) for t in texts]


def near_marks(rng, n, centres, flips):
    made = []
    for k in range(n):
        mark = centres[k % len(centres)]
        for bit in rng.integers(0, 64, rng.integers(0, flips)):
            mark ^= 1 << int(bit)
        made.append(mark - (1 << 64) if mark >> 63 else mark)
    return sorted(set(made))


@pytest.mark.parametrize(("distance", "crowd"), [(4, 2048), (4, 4), (3, 4), (0, 2048), (1, 4)])
def test_links_of_marks(spark, monkeypatch, distance, crowd):
    """Buckets spanned in a task, and crowds by their midpoints, connect the same."""
    from telemetra.llm.common import stage
    from telemetra.llm.components import components

    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(distance)
    centres = [int(c) for c in rng.integers(0, 1 << 63, 6)] + [(1 << 64) - 5, 0]
    marks = near_marks(rng, 300, centres, 9)
    nodes = stage(spark.createDataFrame([(m,) for m in marks], "mark long"), "marks")
    got = {m: m for m in marks}
    for r in components(simhash.linked_nodes(nodes, distance)).collect():
        got[r["node"]] = r["component"]
    want = brute.linked([m % (1 << 64) for m in marks], distance)
    groups = {}
    for m in marks:
        groups.setdefault(want[m % (1 << 64)], set()).add(got[m])
    assert all(len(v) == 1 for v in groups.values())
    assert len(set(got.values())) == len(groups)


def test_buckets_stay_whole_in_adaptive_joins(spark):
    """A join planned by sorting and turned to a broadcast as it runs reads its shuffle by mappers."""
    from telemetra.llm.common import stage

    rng = np.random.default_rng(8)
    marks, want = [], set()
    for k in range(300):  # two marks four bits from a third, equal to it in one of five blocks only
        first = int(rng.integers(0, 1 << 63))
        bits = [rng.choice(12, 2, replace=False) + e for i, e in enumerate((0, 13, 26, 38, 51)) if i != k % 5]
        three = [first] + [first ^ sum(1 << int(b[j]) for b in bits) for j in (0, 1)]
        three = [m - (1 << 64) if m >> 63 else m for m in three]
        marks += three
        want |= {frozenset((three[0], m)) for m in three[1:]}
    nodes = spark.createDataFrame([(m,) for m in marks], "mark long").repartition(8)
    nodes = stage(nodes, "marks")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "40000",  # the buckets' keys, not the nodes'
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {frozenset(r) for r in simhash.linked_nodes(nodes, 4).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(want) == 600
    assert got == want


def test_simhash_of_odd_rows(spark, docs):
    rows = [r for r in ODD if r[0] != 9]
    table = docs.filter("doc_id IS NULL OR doc_id <> 9")
    got = sorted(str(tuple(r)) for r in simhash.near_fingerprints(table).collect())
    marks = [(doc, brute.fingerprint(text, 4)) for doc, text in rows]
    group = brute.linked({m for _, m in marks}, 4)
    least = {}
    for doc, m in marks:
        held = least.setdefault(group[m], doc)
        if doc is None or (held is not None and doc < held):
            least[group[m]] = doc
    want = [(d, m - (1 << 64) if m >> 63 else m, least[group[m]]) for d, m in marks]
    assert got == sorted(str(r) for r in want)
    assert simhash.near_fingerprints(docs.limit(0)).count() == 0


def test_simhash_groups_with_rows_without_id(spark):
    """The least doc_id of a group is an id, if any row has one; the least long is an id too."""
    low = -(1 << 63)
    rows = [(None, "a b c d e"), (7, "A b c d e"), (5, "a b c d e"), (low, "p q r s t"), (3, "p q r s t"), (None, None)]
    found = simhash.near_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in found.collect())
    assert got == sorted([("None", "5"), ("7", "5"), ("5", "5"), (str(low), str(low)), ("3", str(low)), ("None", "None")])


def test_op13_on_the_small_table(spark, small):
    got = {r[0]: (r[1], r[2]) for r in queries.op13_simhash(spark, SMALL).collect()}
    marks = {doc: brute.fingerprint(text, 4) for doc, text in small}
    group = brute.linked(set(marks.values()), 4)
    least = {}
    for doc, m in sorted(marks.items()):
        least.setdefault(group[m], doc)
    assert got == {doc: (f"{m:016x}", least[group[m]]) for doc, m in marks.items()}
    assert len({v[1] for v in got.values()}) < len(got)


def test_block_keys_outgrow_the_nodes():
    for nodes in (10, 1 << 17, 1 << 30):
        masks = simhash.block_masks(nodes, 4)
        assert min(m.bit_count() for m in masks) > np.log2(nodes)
        # any four bits leave one choice of blocks alone
        rng = np.random.default_rng(1)
        for _ in range(200):
            bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not m & bits for m in masks)
